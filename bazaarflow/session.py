"""Session factory for local runs; on a cluster the submitted configuration is kept."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app_name: str = "bazaarflow", master: str | None = None, **conf: str) -> SparkSession:
    """Get a session with the settings the operators rely on.

    Adaptive execution picks join strategies from run-time sizes, merges small shuffle partitions and splits
    skewed ones. ``forceOptimizeSkewedJoin`` lets it split a hot join key even when that costs an extra shuffle.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        cores = os.cpu_count() or 8
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("BAZAARFLOW_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(cores))
        )
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
