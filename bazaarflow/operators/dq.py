"""Data-quality checks. Each returns one row ``(check_id, failing_rows, passed)`` unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.columns import parse_timestamp
from bazaarflow.operators.silver import GRAIN
from bazaarflow.schemas import BAD_TIMESTAMP_LIMIT, LABEL_METRICS, HORIZONS, SPLIT_NAMES, missing_columns


def _verdict(df: DataFrame, check_id: str, failing: Column) -> DataFrame:
    counted = df.agg(F.coalesce(failing, F.lit(0)).cast("bigint").alias("failing_rows"))
    return counted.select(F.lit(check_id).alias("check_id"), "failing_rows", (F.col("failing_rows") == 0).alias("passed"))


def dq_required_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """One row per absent column; empty when the contract holds."""
    rows = [(name,) for name in missing_columns(df, required)]
    return df.sparkSession.createDataFrame(rows, "missing_column string")


def column_presence(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: whether ``df`` has it, and how many of its rows hold a value there."""
    absent = set(missing_columns(df, required))
    counts = df.agg(*((F.lit(0).cast("bigint") if name in absent else F.count(F.col(f"`{name}`"))).alias(name) for name in required))
    rows = F.array(
        *(F.struct(F.lit(n).alias("column_name"), F.lit(n not in absent).alias("present"), F.col(f"`{n}`").alias("filled_rows")) for n in required)
    )
    return counts.select(F.inline(rows))


def dq_truncated_horizons(silver: DataFrame, snapshots: Sequence) -> DataFrame:
    """Snapshots whose longest label horizon reaches beyond the last event: their labels count less than a full horizon."""
    last = silver.agg(F.max("event_date").alias("last"))
    reach = F.array(*(F.date_add(F.lit(str(day)).cast("date"), max(HORIZONS)) for day in snapshots))
    beyond = F.size(F.filter(reach, lambda day: F.coalesce(day > F.col("last"), F.lit(True))))
    return _verdict(last, "LABEL_HORIZON_TRUNCATED", F.max(beyond))


def dq_bad_timestamp_ratio(raw: DataFrame, limit: float = BAD_TIMESTAMP_LIMIT) -> DataFrame:
    """Raw rows, rows whose timestamp cannot be parsed, their ratio, and whether it is within the limit."""
    counted = raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(parse_timestamp(F.col("InvoiceDate")).isNull()).alias("bad_timestamp_rows"),
    )
    ratio = F.coalesce(F.try_divide(F.col("bad_timestamp_rows").cast("double"), F.col("total_rows")), F.lit(0.0))
    return counted.withColumn("bad_timestamp_ratio", ratio).withColumn("passed", F.col("bad_timestamp_ratio") <= limit)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def _unique(df: DataFrame, keys: Sequence[str], check_id: str) -> DataFrame:
    return _verdict(duplicate_keys(df, keys), check_id, F.count(F.lit(1)))


def dq_silver_duplicates(silver: DataFrame) -> DataFrame:
    return _unique(silver, GRAIN, "DQ_SILVER_001")


def dq_feature_duplicates(features: DataFrame) -> DataFrame:
    return _unique(features, ("user_id", "as_of_date"), "DQ_GOLD_001")


def dq_train_duplicates(train: DataFrame) -> DataFrame:
    return _unique(train, ("user_id", "as_of_date"), "DQ_GOLD_009")


def dq_invalid_labels(labels: DataFrame) -> DataFrame:
    """Labels whose name is unknown or does not belong to the horizon."""
    allowed = [(metric, h) for metric in LABEL_METRICS for h in HORIZONS]
    fits = reduce(
        lambda a, b: a | b,
        ((F.col("label_name") == f"{metric}_{h}d") & (F.col("window_days") == h) for metric, h in allowed),
    )
    # A NULL name or window is left alone, as a three-valued comparison does.
    return _verdict(labels, "DQ_GOLD_003", F.count_if(~fits))


def dq_invalid_split(splits: DataFrame) -> DataFrame:
    return _verdict(splits, "DQ_GOLD_005", F.count_if(~F.col("split").isin(*SPLIT_NAMES)))


def _split_bounds(splits: DataFrame) -> DataFrame:
    """First and last time of every split per user, in one aggregation."""
    stamp = parse_timestamp(F.col("event_ts"))
    return splits.groupBy("user_id").agg(
        *(
            bound(F.when(F.col("split") == name, stamp)).alias(f"{label}_{name}")
            for name in SPLIT_NAMES
            for label, bound in (("min", F.min), ("max", F.max))
        ),
        F.count_if(stamp.isNull()).alias("bad_rows"),
    )


def dq_split_chronology(splits: DataFrame) -> DataFrame:
    """Users whose train overlaps val or whose val starts after test; a missing side is ignored."""
    bounds = _split_bounds(splits)
    broken = (F.col("max_train") > F.col("min_val")) | (F.col("min_val") > F.col("min_test"))
    return _verdict(bounds, "DQ_GOLD_006", F.count_if(broken))


def dq_split_chronology_strict(splits: DataFrame) -> DataFrame:
    """Users with all three splits whose periods overlap, plus rows whose time cannot be parsed."""
    bounds = _split_bounds(splits)
    complete = F.col("max_train").isNotNull() & F.col("min_val").isNotNull() & F.col("min_test").isNotNull()
    broken = complete & ((F.col("max_train") > F.col("min_val")) | (F.col("max_val") > F.col("min_test")))
    return _verdict(bounds, "SPLIT_CHRONOLOGY_STRICT", F.count_if(broken) + F.sum("bad_rows"))


def dq_index_contiguity(index: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    """An index table must hold unique ids and exactly the positions 0..N-1."""
    repeated_ids = duplicate_keys(index, [id_col]).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeats"))
    repeated_idx = duplicate_keys(index, [idx_col]).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeats"))
    totals = index.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(idx_col).isNull() | (F.col(idx_col) < 0)).alias("unplaced"),
        F.max(idx_col).alias("highest"),
    )
    # Unique, non-negative positions with the highest at N-1 leave no gap.
    gap = F.when(F.coalesce(F.col("highest"), F.lit(-1)) != F.col("rows") - 1, 1).otherwise(0)
    failing = F.col("unplaced") + gap + repeated_ids.scalar() + repeated_idx.scalar()
    counted = totals.select(F.lit(f"INDEX_{idx_col}").alias("check_id"), failing.cast("bigint").alias("failing_rows"))
    return counted.withColumn("passed", F.col("failing_rows") == 0)


def dq_window_in_bounds(silver: DataFrame, min_date: str, max_date: str) -> DataFrame:
    """A configured date window must be ordered and lie inside the silver event dates."""
    low, high = F.lit(str(min_date)).cast("date"), F.lit(str(max_date)).cast("date")
    bounds = silver.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    fits = (low <= high) & (low >= F.col("first")) & (high <= F.col("last"))
    failing = F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1).cast("bigint")
    checked = bounds.select(F.lit("WINDOW_IN_BOUNDS").alias("check_id"), failing.alias("failing_rows"))
    return checked.withColumn("passed", F.col("failing_rows") == 0)


def dq_report(*checks: DataFrame) -> DataFrame:
    """All verdicts as one table."""
    if not checks:
        raise ValueError("a report needs at least one check")
    return reduce(DataFrame.unionByName, (check.select("check_id", "failing_rows", "passed") for check in checks))


def require_passed(report: DataFrame) -> None:
    """Fail the run when any check has failing rows."""
    failed = report.filter(~F.col("passed")).select("check_id", "failing_rows").limit(20).collect()
    if failed:
        raise ValueError("; ".join(f"{row.check_id} failed: {row.failing_rows} row(s)" for row in failed))
