"""Forward-looking labels and the training table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.columns import from_ticks, has_user, to_ticks
from bazaarflow.functions.scale import shuffled
from bazaarflow.operators.features import (
    Snapshots,
    dates_before,
    explode_dates,
    feature_columns,
    month_anchors,
    snapshot_list,
    snapshot_rollup,
)
from bazaarflow.operators.silver import require_event_bounds
from bazaarflow.schemas import FEATURE_COLUMNS, HORIZONS, LABEL_METRICS, LABEL_NAMES, SNAPSHOT_COUNT


def _outcomes_wide(silver: DataFrame, dates: Sequence[date], horizons: Sequence[int]) -> DataFrame:
    """Purchase ticks per (user, snapshot), one column per horizon; NULL when nothing was bought in it.

    Lines shrink to user days first, and a day goes only to the few snapshots whose longest horizon reaches it.
    """
    longest = max(horizons)
    span = (F.col("event_date") > F.lit(dates[0])) & (F.col("event_date") <= F.date_add(F.lit(dates[-1]), longest))
    days = (
        silver.filter(has_user() & (F.col("quantity") > 0) & span)
        .groupBy("user_id", "event_date")
        .agg(F.sum(to_ticks(F.col("line_revenue"))).alias("ticks"))
    )
    day = F.col("event_date")
    reached = explode_dates(dates, dates_before(dates, F.date_sub(day, longest)), dates_before(dates, day))
    placed = days.select("user_id", "event_date", "ticks", reached.alias("as_of_date"))
    wait = F.date_diff(F.col("event_date"), F.col("as_of_date"))
    return placed.groupBy("user_id", "as_of_date").agg(
        *(F.sum(F.when(wait <= h, F.col("ticks"))).alias(f"ticks_{h}") for h in horizons)
    )


def future_outcomes(silver: DataFrame, snapshots: Snapshots, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Revenue of purchase lines and a purchase flag in ``(as_of, as_of + h]`` per user, snapshot and horizon."""
    wide = _outcomes_wide(silver, snapshot_list(snapshots), horizons)
    cells = F.array(*(F.struct(F.lit(h).alias("window_days"), F.col(f"ticks_{h}").alias("ticks")) for h in horizons))
    long = wide.select("user_id", "as_of_date", F.inline(cells)).filter(F.col("ticks").isNotNull())
    return long.select(
        "user_id",
        "as_of_date",
        "window_days",
        from_ticks(F.col("ticks")).alias("net_revenue"),
        F.lit(1.0).alias("purchase_flag"),
    )


def _seen_users(silver: DataFrame, dates: Sequence[date]) -> DataFrame:
    """(user, snapshot) for users first seen up to the snapshot: one minimum per user, then an expansion."""
    first = (
        silver.filter(has_user() & (F.col("event_date") <= F.lit(dates[-1])))
        .groupBy("user_id")
        .agg(F.min("event_date").alias("first_date"))
    )
    since = explode_dates(dates, dates_before(dates, F.col("first_date")), F.lit(len(dates)))
    return first.select("user_id", since.alias("as_of_date"))


def _label_value(metric: str, ticks: Column) -> Column:
    """A label from the purchase ticks of its horizon; NULL ticks mean no purchase."""
    if metric == "purchase":
        return F.when(ticks.isNotNull(), 1.0).otherwise(0.0)
    return from_ticks(F.coalesce(ticks, F.lit(0)))


def _label_columns(prefix: str) -> list[Column]:
    return [
        _label_value(metric, F.col(f"{prefix}_{h}")).alias(f"label_{metric}_{h}d")
        for h in HORIZONS
        for metric in LABEL_METRICS
    ]


def labels_long(silver: DataFrame, snapshots: Snapshots) -> DataFrame:
    """Every label of every user seen up to the snapshot: horizons x metrics, 0.0 where nothing happened."""
    dates = snapshot_list(snapshots)
    outcomes = _outcomes_wide(silver, dates, HORIZONS)
    wide = _seen_users(silver, dates).join(shuffled(outcomes), ["user_id", "as_of_date"], "left")
    cells = F.array(
        *(
            F.struct(
                F.lit(f"{metric}_{h}d").alias("label_name"),
                F.lit(h).alias("window_days"),
                _label_value(metric, F.col(f"ticks_{h}")).alias("label_value"),
            )
            for h in HORIZONS
            for metric in LABEL_METRICS
        )
    )
    return wide.select("user_id", "as_of_date", F.inline(cells))


def labels_pivot(labels: DataFrame) -> DataFrame:
    """One row per user and snapshot with the six labels as columns."""
    return labels.groupBy("user_id", "as_of_date").agg(
        *(F.max(F.when(F.col("label_name") == name, F.col("label_value"))).alias(f"label_{name}") for name in LABEL_NAMES)
    )


def propensity_train_dataset(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with their labels; a user without labels gets 0.0."""
    joined = features.join(labels_pivot(labels), ["user_id", "as_of_date"], "left")
    return joined.select(
        "user_id",
        "as_of_date",
        *FEATURE_COLUMNS,
        *(F.coalesce(f"label_{name}", F.lit(0.0)).alias(f"label_{name}") for name in LABEL_NAMES),
    )


def require_dates_in_bounds(silver: DataFrame, dates: Sequence[date]) -> None:
    """Every snapshot must lie between the first and the last event date."""
    low, high = require_event_bounds(silver)
    for day in dates:
        if not low <= day <= high:
            raise ValueError(f"as_of_date {day} is outside the silver event dates [{low}, {high}]")


def propensity_panel(
    silver: DataFrame, panel_end: date | str, months: int = SNAPSHOT_COUNT, check_bounds: bool = True
) -> DataFrame:
    """Training table for all snapshots in one job.

    Same rows as joining features with the pivoted long labels, but both come from one pass over silver, without a join.
    """
    dates = month_anchors(panel_end, months)
    if check_bounds:
        require_dates_in_bounds(silver, dates)
    rollup = snapshot_rollup(silver, dates, HORIZONS)
    labels = _label_columns("future")
    return rollup.select("user_id", "as_of_date", *feature_columns(), *labels)
