"""Point-in-time features, labels, splits and data-quality checks on literal rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import dq, features, labels, splits
from bazaarflow.schemas import LABEL_NAMES, SILVER_SCHEMA, require_columns

AS_OF = date(2020, 6, 30)


def line(invoice, item, day, quantity, revenue, user, country="France", hour=10):
    stamp = datetime.fromisoformat(f"{day} {hour:02d}:00:00")
    return (invoice, item, "x", quantity, stamp, stamp.date(), 1.0, revenue, user, country)


@pytest.fixture(scope="module")
def clean(spark):
    rows = [
        line("i1", "a", "2020-06-30", 1, 10.0, "u1", "France"),  # age 0
        line("i2", "a", "2020-06-01", 1, 20.0, "u1", "Spain"),  # age 29, last day of the 30-day window
        line("i3", "a", "2020-05-31", 1, 40.0, "u1"),  # age 30, first day outside it
        line("i3", "b", "2020-05-31", 2, 1.25, "u1"),
        line("i4", "a", "2020-03-03", 1, 80.0, "u1"),  # age 119
        line("i5", "a", "2020-03-02", 1, 160.0, "u1"),  # age 120
        line("i6", "a", "2020-06-20", -1, -5.0, "u2"),  # only returns
        line("i7", "a", "2020-07-01", 1, 7.0, "u1"),  # first day of the labels
        line("i8", "a", "2020-07-30", 1, 3.0, "u1"),  # day 30
        line("i9", "a", "2020-07-31", -1, -3.0, "u1"),  # a return is no purchase
        line("i10", "a", "2020-08-29", 1, 2.0, "u3"),  # not seen before the snapshot
        line("i11", "a", "2020-06-10", 1, 9.0, ""),  # no user
        line("i12", "a", "2020-06-10", 1, 9.0, None),
    ]
    return spark.createDataFrame(rows, SILVER_SCHEMA)


def test_windows_are_inclusive_and_labels_start_the_day_after(clean):
    rows = {r.user_id: r for r in features.user_features_asof(clean, [AS_OF]).collect()}
    assert set(rows) == {"u1", "u2"}
    u1, u2 = rows["u1"], rows["u2"]
    assert (u1.recency_days, u1.country) == (0, "France")
    assert [u1[f"frequency_{w}d"] for w in (30, 60, 90, 120)] == [2, 3, 3, 4]
    assert [u1[f"monetary_{w}d"] for w in (30, 60, 90, 120)] == [30.0, 71.25, 71.25, 151.25]
    assert u1.avg_basket_value_60d == 23.75 and u1.avg_basket_value_120d == pytest.approx(37.8125)
    assert (u2.recency_days, u2.country, u2.frequency_120d, u2.monetary_120d) == (9999, "UNKNOWN", 0, 0.0)

    wide = {r.user_id: r for r in labels.labels_pivot(labels.labels_long(clean, [AS_OF])).collect()}
    assert set(wide) == {"u1", "u2"}
    assert wide["u1"].label_net_revenue_30d == 10.0 and wide["u1"].label_purchase_30d == 1.0
    assert wide["u2"].label_purchase_90d == 0.0
    assert set(wide["u1"].asDict()) == {"user_id", "as_of_date", *(f"label_{n}" for n in LABEL_NAMES)}


def test_panel_equals_features_joined_with_labels(clean):
    dates = features.month_anchors("2020-08-31", 6)
    panel = labels.propensity_panel(clean, "2020-08-31", 6, check_bounds=False)
    joined = labels.propensity_train_dataset(features.user_features_asof(clean, dates), labels.labels_long(clean, dates))
    assert panel.columns == joined.columns
    assert panel.exceptAll(joined).count() == 0 and joined.exceptAll(panel).count() == 0
    # u3 appears only in snapshots after its first event
    assert {str(r.as_of_date) for r in panel.filter("user_id = 'u3'").collect()} == {"2020-08-31"}


def test_one_job_for_many_snapshots_equals_one_per_snapshot(clean):
    dates = features.month_anchors("2020-08-31", 6)
    together = features.user_features_asof(clean, dates)
    apart = None
    for day in dates:
        part = features.user_features_asof(clean, [day])
        apart = part if apart is None else apart.unionByName(part)
    assert together.exceptAll(apart).count() == 0 and apart.exceptAll(together).count() == 0


def test_composed_operators_agree_with_the_fused_features(clean):
    bought = features.positive_events(features.asof_events(clean, [AS_OF]))
    fused = features.user_features_asof(clean, [AS_OF]).filter("frequency_120d > 0")
    parts = (
        features.lookback_frequency(bought)
        .join(features.lookback_monetary(bought), ["user_id", "as_of_date"])
        .join(features.avg_basket_value(features.invoice_totals_windowed(bought)), ["user_id", "as_of_date"])
    )
    names = [c for c in fused.columns if c.startswith(("user_id", "frequency", "monetary", "avg"))]
    assert fused.select(names).exceptAll(parts.select(names)).count() == 0


def test_result_does_not_depend_on_partitioning(spark, clean):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = features.user_features_asof(clean, [AS_OF]).collect()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = features.user_features_asof(clean.repartition(7), [AS_OF]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == sorted(expected)


def test_latest_country_prefers_the_latest_time_then_the_largest_name(spark):
    rows = [
        line("i1", "a", "2020-06-01", 1, 1.0, "u1", "Spain", 9),
        line("i2", "a", "2020-06-01", 1, 1.0, "u1", "Austria", 11),
        line("i3", "a", "2020-06-01", 1, 1.0, "u1", "Belgium", 11),
    ]
    silver = spark.createDataFrame(rows, SILVER_SCHEMA)
    latest = features.latest_event_per_user(features.positive_events(features.asof_events(silver, [AS_OF]))).first()
    assert latest.country == "Belgium"
    assert features.user_features_asof(silver, [AS_OF]).first().country == "Belgium"


def test_month_anchors_clamp_to_the_month(spark):
    days = [str(d) for d in features.month_anchors("2021-03-31")]
    assert days[-2:] == ["2021-02-28", "2021-03-31"] and len(days) == 12 and days[0] == "2020-04-30"
    assert [str(r.as_of_date) for r in features.snapshot_dates(spark, "2021-03-31").orderBy("as_of_date").collect()] == days


def test_snapshot_outside_the_data_is_rejected(clean):
    with pytest.raises(ValueError):
        labels.propensity_panel(clean, "2021-08-31")


SPLIT_COLUMNS = "user_id string, item_id string, invoice_id string, event_ts string, event_date string, weight int"


def test_an_invoice_is_never_divided(spark):
    rows = [
        ("u1", "i1", "inv_old", "2024-01-01 10:00:00", "2024-01-01", 1),
        ("u1", "i2", "inv_mid", "2024-01-02 10:00:00", "2024-01-02", 1),
        ("u1", "i3", "inv_new", "2024-01-03 10:00:00", "2024-01-03", 1),
        ("u1", "i4", "inv_new", "2024-01-03 10:00:00", "2024-01-03", 1),
        ("u2", "i1", "only", "2024-01-03 10:00:00", "2024-01-03", 1),
    ]
    out = splits.user_item_splits(spark.createDataFrame(rows, SPLIT_COLUMNS))
    got = {(r.user_id, r.item_id): r.split for r in out.collect()}
    assert got == {("u1", "i1"): "train", ("u1", "i2"): "val", ("u1", "i3"): "test", ("u1", "i4"): "test", ("u2", "i1"): "test"}
    users, items = splits.user_index(out), splits.item_index(out)
    assert sorted(map(tuple, users.collect())) == [("u1", 0), ("u2", 1)]
    assert list(map(tuple, items.collect())) == [("i1", 0)]
    assert dq.dq_index_contiguity(users, "user_id", "user_idx").first().passed


def test_recency_rank_of_a_user_with_most_rows(spark):
    """One user holds nearly all occasions; ranks still count 1..n without a gap."""
    busy = spark.range(20000).selectExpr(
        "'hot' AS user_id", "CAST(id AS STRING) AS invoice_id", "CAST(TIMESTAMP'2024-01-01' + make_dt_interval(0, 0, 0, id DIV 3) AS STRING) AS event_ts"
    )
    few = spark.createDataFrame([("cold", "a", "2024-01-01 00:00:00"), ("cold", "b", "2024-01-02 00:00:00")], busy.schema)
    ranked = splits.invoice_recency_rank(busy.unionByName(few)).toPandas()
    hot = ranked[ranked.user_id == "hot"].sort_values(["event_ts", "invoice_id"], ascending=False)
    assert hot.recency_rank.tolist() == list(range(1, 20001))
    assert dict(zip(*ranked[ranked.user_id == "cold"][["invoice_id", "recency_rank"]].values.T)) == {"b": 1, "a": 2}


def test_chronology_violation_is_counted(spark):
    rows = [
        ("u1", "i1", "train", "2024-01-03 00:00:00"),
        ("u1", "i2", "val", "2024-01-02 00:00:00"),
        ("u1", "i3", "test", "2024-01-04 00:00:00"),
        ("u2", "i1", "val", "2024-01-05 00:00:00"),
        ("u2", "i1", "val", "2024-01-09 00:00:00"),
        ("u2", "i1", "test", "2024-01-06 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "user_id string, item_id string, split string, event_ts string")
    assert dq.dq_split_chronology(df).first().failing_rows == 1
    assert dq.dq_split_chronology_strict(df).first().failing_rows == 1
    overlap = df.withColumn("split", F.when(F.col("event_ts") == "2024-01-05 00:00:00", "train").otherwise(F.col("split")))
    assert dq.dq_split_chronology_strict(overlap.filter("user_id = 'u2'")).first().failing_rows == 1
    with pytest.raises(ValueError, match="DQ_GOLD_006"):
        dq.require_passed(dq.dq_report(dq.dq_split_chronology(df)))
    with pytest.raises(ValueError, match="event_ts"):
        require_columns(df.drop("event_ts"), ["user_id", "item_id", "split", "event_ts"], "split dataset")


def test_checks_see_planted_errors(spark):
    bad_labels = spark.createDataFrame(
        [("u", "purchase_30d", 30), ("u", "purchase_30d", 60), ("u", "refund_30d", 30)], "user_id string, label_name string, window_days int"
    )
    assert dq.dq_invalid_labels(bad_labels).first().failing_rows == 2
    split = spark.createDataFrame([("train",), ("TEST",), ("holdout",)], "split string")
    assert dq.dq_invalid_split(split).first().failing_rows == 2
    keyed = spark.createDataFrame([("u", "d"), ("u", "d"), ("v", "d")], "user_id string, as_of_date string")
    assert dq.dq_feature_duplicates(keyed).first().failing_rows == 1
    for rows in ([("a", 0), ("b", 2)], [("a", 0), ("a", 1)], [("a", 0), ("b", 0)], [("a", 1), ("b", 2)]):
        assert not dq.dq_index_contiguity(spark.createDataFrame(rows, "id string, idx bigint"), "id", "idx").first().passed


def test_window_bounds(clean):
    assert dq.dq_window_in_bounds(clean, "2020-04-01", "2020-05-01").first().passed
    assert not dq.dq_window_in_bounds(clean, "2020-05-01", "2020-04-01").first().passed
    assert not dq.dq_window_in_bounds(clean, "2019-05-01", "2020-04-01").first().passed
