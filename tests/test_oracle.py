"""Every query with an exact meaning against its SQL, on the smallest given tables; and the shape of its plan."""

from __future__ import annotations

import re

import pytest
from compare import compare, connect

from bazaarflow.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"
STATEMENTS = oracle.all_statements()
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    # A window straight over a single-partition exchange would put the whole table into one task.
    assert not re.search(r"Window \[.*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)
    ok, detail = compare(con, frame, STATEMENTS[name])
    assert ok, detail
