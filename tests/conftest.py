from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaarflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Small inputs would be merged into one partition; keep several, so that block borders are exercised.
    conf = {"spark__sql__shuffle__partitions": "4", "spark__sql__adaptive__coalescePartitions__enabled": "false"}
    conf["spark__sql__maxMetadataStringLength"] = "4000"
    session = build_session("tests", master="local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
