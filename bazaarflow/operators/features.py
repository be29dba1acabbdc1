"""Point-in-time customer features.

Every operator works on a whole set of snapshots at once and carries ``as_of_date`` as a key. Snapshots are a short,
fixed list of dates (twelve by default), so they enter the plan as an array literal: each event is expanded only to the
snapshots it belongs to, and no join is needed.
"""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarflow.functions.columns import from_ticks, has_user, to_ticks
from bazaarflow.schemas import LOOKBACKS, NO_PURCHASE_RECENCY, SNAPSHOT_COUNT, UNKNOWN_COUNTRY, WINDOWS

Snapshots = Sequence[date] | DataFrame


def month_anchors(panel_end: date | str, months: int = SNAPSHOT_COUNT) -> list[date]:
    """Month steps back from the end date, oldest first; each is clamped to its own month's length."""
    end = date.fromisoformat(str(panel_end))
    anchors = []
    for back in range(months - 1, -1, -1):
        year, month0 = divmod(end.year * 12 + end.month - 1 - back, 12)
        anchors.append(date(year, month0 + 1, min(end.day, calendar.monthrange(year, month0 + 1)[1])))
    return anchors


def snapshot_dates(spark: SparkSession, panel_end: date | str, months: int = SNAPSHOT_COUNT) -> DataFrame:
    """The panel's as-of dates, one row each."""
    end = F.lit(str(panel_end)).cast("date")
    back = F.col("id").cast("int") - F.lit(months - 1)
    return spark.range(months).select(F.add_months(end, back).alias("as_of_date"))


def snapshots_in_bounds(silver: DataFrame, panel_end: date | str, months: int = SNAPSHOT_COUNT) -> DataFrame:
    """The as-of dates, and whether each lies between the first and the last event of ``silver``."""
    bounds = silver.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    back = F.sequence(F.lit(1 - months), F.lit(0))
    dates = F.transform(back, lambda m: F.add_months(F.lit(str(panel_end)).cast("date"), m))
    inside = F.col("as_of_date").between(F.col("first"), F.col("last"))
    return bounds.select("first", "last", F.explode(dates).alias("as_of_date")).select("as_of_date", F.coalesce(inside, F.lit(False)).alias("in_bounds"))


def snapshot_list(snapshots: Snapshots) -> list[date]:
    """Sorted distinct dates; a snapshot table is a handful of rows by contract."""
    values = [row[0] for row in snapshots.select("as_of_date").collect()] if isinstance(snapshots, DataFrame) else snapshots
    dates = sorted({date.fromisoformat(str(value)) for value in values})
    if not dates:
        raise ValueError("At least one snapshot date is required.")
    return dates


def dates_before(dates: Sequence[date], day: Column) -> Column:
    """How many of the sorted dates lie before ``day``."""
    return reduce(lambda a, b: a + b, ((F.lit(d) < day).cast("int") for d in dates))


def explode_dates(dates: Sequence[date], skip: Column, until: Column) -> Column:
    """One row for each of the sorted dates number ``skip`` to ``until`` (0-based, end excluded)."""
    return F.explode(F.slice(F.array(*(F.lit(d) for d in dates)), skip + 1, F.greatest(until - skip, F.lit(0))))


def asof_events(silver: DataFrame, snapshots: Snapshots) -> DataFrame:
    """Events of known users up to and including each snapshot, returns included."""
    dates = snapshot_list(snapshots)
    events = silver.filter(has_user() & (F.col("event_date") <= F.lit(dates[-1])))
    reached = explode_dates(dates, dates_before(dates, F.col("event_date")), F.lit(len(dates)))
    return events.select(
        reached.alias("as_of_date"),
        "user_id",
        "invoice_id",
        "event_ts",
        "event_date",
        "line_revenue",
        "country",
        "quantity",
    )


def positive_events(events: DataFrame) -> DataFrame:
    """Purchases only."""
    return events.filter(F.col("quantity") > 0)


def asof_users(events: DataFrame) -> DataFrame:
    """Users seen up to each snapshot, those with returns only included."""
    return events.select("user_id", "as_of_date").distinct()


def latest_event_per_user(positive: DataFrame) -> DataFrame:
    """Time and country of each user's last purchase; for equal times the largest known country.

    The first step groups by country too, so that the large aggregation carries a plain timestamp.
    """
    last = positive.groupBy("user_id", "as_of_date", "country").agg(F.max("event_ts").alias("last_event_ts"))
    latest = last.groupBy("user_id", "as_of_date").agg(F.max(F.struct("last_event_ts", "country")).alias("latest"))
    return latest.select("user_id", "as_of_date", "latest.last_event_ts", "latest.country")


def _age(as_of: Column | None = None) -> Column:
    """Days between the event and the snapshot; a lookback of w days holds ages 0..w-1."""
    return F.date_diff(F.col("as_of_date") if as_of is None else as_of, F.col("event_date"))


def lookback_frequency(positive: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Distinct invoices per trailing window.

    An invoice counts when its latest day is in the window, which needs one aggregation per invoice instead of one
    distinct count per window.
    """
    invoices = positive.groupBy("user_id", "as_of_date", "invoice_id").agg(F.max("event_date").alias("event_date"))
    return invoices.groupBy("user_id", "as_of_date").agg(
        *(F.count_if(_age() < days).alias(f"frequency_{days}d") for days in windows)
    )


def lookback_monetary(positive: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Purchase revenue per trailing window; 0 when there is none."""
    ticks = to_ticks(F.col("line_revenue"))
    return positive.groupBy("user_id", "as_of_date").agg(
        *(from_ticks(F.sum(F.when(_age() < days, ticks).otherwise(0))).alias(f"monetary_{days}d") for days in windows)
    )


def invoice_totals_windowed(positive: DataFrame, windows: Sequence[int] = LOOKBACKS) -> DataFrame:
    """Invoice revenue inside each lookback window."""
    reach = F.filter(F.array(*(F.lit(days) for days in windows)), lambda w: w > _age())
    daily = positive.groupBy("user_id", "as_of_date", "invoice_id", "event_date").agg(
        F.sum(to_ticks(F.col("line_revenue"))).alias("ticks")
    )
    placed = daily.select("user_id", "as_of_date", "invoice_id", F.explode(reach).alias("lookback_window_days"), "ticks")
    return placed.groupBy("user_id", "as_of_date", "invoice_id", "lookback_window_days").agg(
        from_ticks(F.sum("ticks")).alias("invoice_revenue")
    )


def avg_basket_value(invoice_totals: DataFrame, windows: Sequence[int] = LOOKBACKS) -> DataFrame:
    """Mean invoice total per window, one column per window; NULL where a window has no invoice."""
    ticks = to_ticks(F.col("invoice_revenue"))
    in_window = {days: F.col("lookback_window_days") == days for days in windows}
    return invoice_totals.groupBy("user_id", "as_of_date").agg(
        *(
            _mean_ticks(F.sum(F.when(keep, ticks)), F.count_if(keep)).alias(f"avg_basket_value_{days}d")
            for days, keep in in_window.items()
        )
    )


def _mean_ticks(total: Column, count: Column) -> Column:
    """Mean rounded to four decimals, NULL for an empty group."""
    return from_ticks(F.round(F.try_divide(total.cast("double"), count.cast("double"))))


def snapshot_rollup(silver: DataFrame, dates: Sequence[date], horizons: Sequence[int] = ()) -> DataFrame:
    """Lookback sums, last purchase and, when asked, forward sums of every (user, snapshot) in one pass.

    1. Lines shrink to (user, invoice, day, country) before anything is expanded.
    2. A day goes only to the snapshots within reach: the first one after it, those whose longest lookback covers it, and
       those whose longest horizon it falls in. These are neighbours in the sorted list, so they are one slice of it.
    3. Sums go over invoices first and then over users, both combined before the shuffle.
    4. The at most one row per user and snapshot is carried forward over the snapshots that had nothing in reach.
    """
    day, longest = F.col("event_date"), max(WINDOWS)
    ahead = max(horizons, default=0)
    bought = F.col("quantity") > 0
    days = (
        silver.filter(has_user() & (day <= F.date_add(F.lit(dates[-1]), ahead)))
        .groupBy("user_id", "invoice_id", "event_date", "country")
        .agg(
            F.sum(F.when(bought, to_ticks(F.col("line_revenue")))).alias("ticks"),
            F.max(F.when(bought, F.col("event_ts"))).alias("last_ts"),
        )
    )
    first_after = dates_before(dates, day)
    covered = F.greatest(dates_before(dates, F.date_add(day, longest)), first_after + 1)
    begin = dates_before(dates, F.date_sub(day, ahead)) if horizons else first_after
    placed = days.withColumn("as_of_date", explode_dates(dates, begin, F.least(covered, F.lit(len(dates)))))

    past = _age() >= 0
    invoices = placed.groupBy("user_id", "as_of_date", "invoice_id").agg(
        *(F.sum(F.when(past & (_age() < w), F.col("ticks"))).alias(f"ticks_{w}") for w in WINDOWS),
        *(F.sum(F.when(_age().between(-h, -1), F.col("ticks"))).alias(f"future_{h}") for h in horizons),
        F.max(past).alias("seen"),
        F.max(F.when(past & F.col("last_ts").isNotNull(), F.struct("last_ts", "country"))).alias("latest"),
    )
    # ticks_w is NULL exactly when the invoice has no purchase line in the window, so counting it counts invoices.
    active = invoices.groupBy("user_id", "as_of_date").agg(
        *(F.count(f"ticks_{w}").alias(f"frequency_{w}d") for w in WINDOWS),
        *(F.coalesce(F.sum(f"ticks_{w}"), F.lit(0)).alias(f"ticks_{w}") for w in WINDOWS),
        *(F.sum(f"future_{h}").alias(f"future_{h}") for h in horizons),
        F.max("seen").alias("seen"),
        F.max("latest").alias("latest"),
    )

    in_time = Window.partitionBy("user_id").orderBy("as_of_date")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.lead("as_of_date").over(in_time)
    spans = active.withColumns(
        {
            "until": F.coalesce(dates_before(dates, following), F.lit(len(dates))),
            "seen": F.max("seen").over(so_far),
            "latest": F.max("latest").over(so_far),
        }
    ).filter("seen")
    carried = spans.withColumnRenamed("as_of_date", "from_date").withColumn(
        "as_of_date", explode_dates(dates, dates_before(dates, F.col("from_date")), F.col("until"))
    )
    now = F.col("as_of_date") == F.col("from_date")
    zero = F.lit(0).cast("bigint")
    return carried.select(
        "user_id",
        "as_of_date",
        *(
            F.when(now, F.col(f"{kind}_{w}{unit}")).otherwise(zero).alias(f"{kind}_{w}{unit}")
            for kind, unit in (("frequency", "d"), ("ticks", ""))
            for w in WINDOWS
        ),
        *(F.when(now, F.col(f"future_{h}")).alias(f"future_{h}") for h in horizons),
        F.col("latest.last_ts").alias("last_ts"),
        F.col("latest.country").alias("country"),
    )


def feature_columns() -> list[Column]:
    """Feature columns over the rows of :func:`snapshot_rollup`."""
    recency = F.date_diff(F.col("as_of_date"), F.to_date("last_ts"))
    baskets = {w: _mean_ticks(F.col(f"ticks_{w}"), F.col(f"frequency_{w}d")) for w in LOOKBACKS}
    return [
        F.coalesce(recency, F.lit(NO_PURCHASE_RECENCY)).cast("bigint").alias("recency_days"),
        *(F.col(f"frequency_{w}d") for w in WINDOWS),
        *(from_ticks(F.col(f"ticks_{w}")).alias(f"monetary_{w}d") for w in WINDOWS),
        *(F.coalesce(mean, F.lit(0.0)).alias(f"avg_basket_value_{w}d") for w, mean in baskets.items()),
        F.coalesce("country", F.lit(UNKNOWN_COUNTRY)).alias("country"),
    ]


def user_features_asof(silver: DataFrame, snapshots: Snapshots) -> DataFrame:
    """One row of features per user and snapshot, for users with any event up to it."""
    return snapshot_rollup(silver, snapshot_list(snapshots)).select("user_id", "as_of_date", *feature_columns())
