"""Physical plans: pruned and filtered scans, one pass over silver, ranking cut before the shuffle."""

from __future__ import annotations

import re

from bazaarflow.operators import features, labels, silver, splits
from bazaarflow.plans import registry
from bazaarflow.sources import readers, writers

SF_DIR = "/root/testdata/sf0.001"
def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_filter_and_columns_reach_the_scan(spark, tmp_path):
    clean = silver.silver_transactions(readers.retail_lines(spark, SF_DIR))
    path = str(tmp_path / "panel")
    panel = labels.propensity_panel(clean, "2000-12-01", check_bounds=False)
    writers.parquet_sink(panel, path, partition_by="as_of_date")
    plan = plan_of(readers.read_panel(spark, path, ["2000-12-01"], allow_empty=True).select("user_id", "monetary_90d"))
    assert re.search(r"PartitionFilters: \[[^\]]*as_of_date#\d+ = 2000-12-01", plan)
    assert "ReadSchema: struct<user_id:string,monetary_90d:double>" in plan


def test_date_filter_and_columns_reach_silver(spark, tmp_path):
    path = str(tmp_path / "silver")
    writers.parquet_sink(silver.silver_transactions(readers.retail_lines(spark, SF_DIR)), path)
    stored = spark.read.parquet(path)
    plan = plan_of(splits.interaction_events(stored, "1998-01-01", "2000-12-31"))
    assert "GreaterThanOrEqual(event_date,1998-01-01)" in plan and "GreaterThan(quantity,0)" in plan
    plan = plan_of(features.user_features_asof(stored, registry.PANEL))
    assert "LessThanOrEqual(event_date,2000-12-01)" in plan
    assert "item_description" not in plan and "unit_price" not in plan


def test_panel_reads_silver_once(spark, tmp_path):
    path = str(tmp_path / "silver")
    writers.parquet_sink(silver.silver_transactions(readers.retail_lines(spark, SF_DIR)), path)
    plan = plan_of(labels.propensity_panel(spark.read.parquet(path), "2000-12-01", check_bounds=False))
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_split_ranking_is_cut_before_the_shuffle(spark):
    plan = plan_of(splits.user_item_splits(registry._interactions(spark, SF_DIR)))
    assert "WindowGroupLimit" in plan and "Partial" in plan
