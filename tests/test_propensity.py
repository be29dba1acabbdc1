"""Preparation, metrics, policies, gaps and models on small inputs checked by hand or by NumPy."""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarflow.functions.scale import stored
from bazaarflow.operators import metrics, models, policy, prep, sensitivity
from bazaarflow.schemas import check_windows


def snapshots(spark, days):
    rows = [(f"u{i}", str(d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "user_id string, as_of_date string")


@pytest.mark.parametrize("year,day", [(2020, 1), (2021, 15)])
def test_ten_one_one(spark, year, day):
    rows = prep.split_10_1_1(snapshots(spark, [date(year, m, day) for m in range(1, 13)]))
    by_slice = {s: sorted(r.as_of_date for r in rows.filter(F.col("slice") == s).collect()) for s in prep.SLICES}
    assert [len(by_slice[s]) for s in prep.SLICES] == [10, 1, 1]
    assert max(by_slice["train"]) < by_slice["validation"][0] < by_slice["test"][0]


@pytest.mark.parametrize("count", [0, 11, 13])
def test_other_snapshot_counts_are_rejected(spark, count):
    with pytest.raises(ValueError):
        prep.split_10_1_1(snapshots(spark, [date(2020, 1, 1) + timedelta(days=30 * i) for i in range(count)]))


def test_missing_feature_column_is_rejected(spark):
    panel = spark.createDataFrame(
        [("u", "2021-01-01", "France", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
        "user_id string, as_of_date string, country string, recency_days double, frequency_30d double, monetary_30d double, "
        "monetary_90d double, avg_basket_value_90d double, label_purchase_30d double, label_net_revenue_30d double",
    )
    with pytest.raises(ValueError, match="frequency_90d"):
        prep.training_rows(panel, 30, 90)


@pytest.mark.parametrize("kwargs", [{"horizon": 45}, {"lookback": 30}, {"lookback": 150}])
def test_windows_outside_the_contract(kwargs):
    with pytest.raises(ValueError):
        check_windows(**kwargs)


def test_cap_and_one_hot(spark):
    train = spark.createDataFrame([("a", 1.0, "France"), ("b", 9.0, "Spain")], "user_id string, monetary_90d double, country string")
    cap = prep.spend_cap_value(train, 90, 0.5).first()[0]
    assert cap == 5.0
    rows = spark.createDataFrame([("c", 7.0, "Italy"), ("d", 2.0, "Spain")], train.schema)
    assert sorted(r.monetary_90d for r in prep.apply_spend_cap(rows, 90, cap).collect()) == [2.0, 5.0]
    flags = {r.user_id: (r.country_France, r.country_Spain) for r in prep.country_one_hot(train, rows).collect()}
    assert flags == {"c": (0.0, 0.0), "d": (0.0, 1.0)}


def test_sparse_flags_of_a_large_vocabulary(spark):
    n = 100_000
    train = spark.range(n).selectExpr("concat('c', lpad(id, 6, '0')) AS country").unionByName(
        spark.createDataFrame([(None,), ("c000007",)], "country string")
    )
    vocabulary, size = prep.country_vocabulary(train)
    rows = spark.createDataFrame([("a", "c000000"), ("b", "c099999"), ("c", "elsewhere"), ("d", None)], "user_id string, country string")
    flags = {r.user_id: r.country_flags for r in prep.country_vectors(rows, vocabulary, size).collect()}
    assert size == n and all(v.size == n for v in flags.values())
    assert {u: list(v.indices) for u, v in flags.items()} == {"a": [0], "b": [n - 1], "c": [], "d": []}
    assert flags["a"].values == [1.0]
    with pytest.raises(ValueError):
        prep.country_vectors(rows, vocabulary.limit(0), 0)


def test_sketched_cap_keeps_its_rank_error(spark):
    values = np.random.default_rng(3).lognormal(3, 2, 60_000)
    df = spark.createDataFrame(pd.DataFrame({"monetary_90d": values})).repartition(9)
    for accuracy in (100, 1000):
        frame = prep.spend_cap_sketch(df, 90, 0.9, accuracy)
        cap = frame.first()[0]
        assert cap in values and abs((values <= cap).sum() - 0.9 * len(values)) <= len(values) / accuracy + 1
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "rangepartitioning" not in plan
    assert prep.spend_cap_sketch(df.limit(0), 90).first()[0] is None


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    score = np.round(rng.random(700), 2)  # many equal scores
    score[:233] = 0.5  # one of them holds a third of the rows
    label = (rng.random(700) < score).astype(float)
    rows = [(f"u{i:04d}", "2021-01-01", float(y), float(s)) for i, (y, s) in enumerate(zip(label, score))]
    return spark.createDataFrame(rows, "user_id string, as_of_date string, y double, s double"), label, score


def test_auc_and_average_precision(scored):
    df, y, s = scored
    row = metrics.ranking_quality(df, "y", "s").first()
    pairs = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    assert row.roc_auc == pytest.approx(pairs.mean(), abs=1e-12)
    expected, before = 0.0, 0.0
    for threshold in sorted(set(s), reverse=True):
        taken = s >= threshold
        recall = y[taken].sum() / y.sum()
        expected += (recall - before) * y[taken].mean()
        before = recall
    assert row.average_precision == pytest.approx(expected, abs=1e-12)
    assert metrics.roc_auc(df, "y", "s").first()[0] == row.roc_auc


def test_auc_needs_both_classes(scored):
    df, _, _ = scored
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None
    assert metrics.average_precision(df.filter("y = 0"), "y", "s").first()[0] == 0.0


def test_lift_brier_ece(scored):
    df, y, s = scored
    best = sorted(range(700), key=lambda i: (-s[i], i))[:70]
    row = metrics.top_decile_lift(df, "y", "s").first()
    assert row.top_decile_positive_rate == pytest.approx(y[best].mean())
    assert row.top_decile_lift == pytest.approx(y[best].mean() / y.mean())
    assert metrics.brier_score(df, "y", "s").first()[0] == pytest.approx(((s - y) ** 2).mean())
    bins = np.clip(np.digitize(s, np.linspace(0, 1, 11)) - 1, 0, 9)
    gap = sum(abs(s[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert metrics.ece_10_bin(df, "y", "s").first()[0] == pytest.approx(gap)


def test_revenue_errors_skip_zero_actuals(spark):
    df = spark.createDataFrame([(1.0, 10.0, 8.0), (1.0, 0.0, 3.0), (0.0, 99.0, 1.0)], "purchase_label double, a double, p double")
    row = metrics.revenue_errors(df, "a", "p").first()
    assert (row.row_count, row.mae, row.mape) == (2, 2.5, 0.2) and row.rmse == pytest.approx(np.sqrt(6.5), abs=1e-6)
    empty = metrics.revenue_errors(df.filter("purchase_label = 0"), "a", "p").first()
    assert empty.row_count == 0 and empty.rmse is None and empty.mape is None


def test_policy_scores_by_hand(spark):
    rows = spark.createDataFrame(
        [("u1", "2021-01-01", 1.0, 2.0, 10.0, 0.1, 100.0), ("u2", "2021-01-01", 2.0, 3.0, 20.0, 0.2, 120.0)],
        "user_id string, as_of_date string, recency_days double, frequency_90d double, monetary_90d double, "
        "propensity_score double, predicted_conditional_revenue double",
    )
    out = policy.rfm_policy_score(policy.random_policy_score(policy.expected_value_score(rows)), 90).orderBy("user_id").collect()
    assert [r.expected_value_score for r in out] == pytest.approx([10.0, 24.0])
    assert [r.rfm_policy_score for r in out] == pytest.approx([1.6, 1 / 3 + 1.5 + 0.2])
    digest = hashlib.sha256(b"u1|2021-01-01|policy_random").hexdigest()
    assert out[0].random_policy_score == int(digest[:16], 16) / float(0xFFFFFFFFFFFFFFFF)


def test_budget_rules(spark):
    rows = spark.createDataFrame([(f"u{i}", "d", float(i // 2)) for i in range(6)], "user_id string, as_of_date string, s double")
    assert [r.user_id for r in policy.budget_top_k(rows, "s", 17.0, 5.0).orderBy("user_id").collect()] == ["u2", "u4", "u5"]
    for budget, cost in ((0.0, 5.0), (5.0, 0.0), (4.0, 5.0)):
        with pytest.raises(ValueError):
            policy.budget_top_k(rows, "s", budget, cost)


def test_gaps(spark):
    days = ["2026-01-01", "2026-01-10", "2026-01-10", "2026-01-25"]
    rows = [("u1", d, 1) for d in days] + [("u2", "2026-01-01", 1), (None, "2026-01-01", 1), (None, "2026-03-01", 1), ("u1", "2026-01-12", -1)]
    silver = spark.createDataFrame(rows, "user_id string, d string, quantity int").selectExpr("user_id", "quantity", "CAST(d AS DATE) AS event_date")
    gaps = sensitivity.inter_purchase_gaps(silver)
    assert sorted(r.gap_days for r in gaps.collect()) == [9, 15]
    row = sensitivity.gap_distribution(gaps).first()
    assert (row.gap_observation_count, row.median_gap_days, row.mean_gap_days) == (2, 15, 12.0)
    covered = {r.window_days: r.inter_purchase_gap_coverage for r in sensitivity.gap_coverage(gaps, (9, 10, 15)).collect()}
    assert covered == {9: 0.5, 10: 0.5, 15: 1.0}
    empty = sensitivity.gap_distribution(gaps.limit(0)).first()
    assert empty.gap_observation_count == 0 and empty.median_gap_days is None
    assert sensitivity.gap_coverage(gaps.limit(0)).count() == 0


def test_freeze_decision_ties_take_the_first(spark):
    columns = "sweep string, window_days int, model_order int, model_name string, average_precision double"
    rows = [("horizon", 30, 0, "a", 0.5), ("horizon", 60, 1, "b", 0.5), ("lookback", 90, 1, "b", 0.7), ("lookback", 90, 0, "a", 0.7), ("lookback", 120, 0, "a", 0.1)]
    row = sensitivity.freeze_decision(spark.createDataFrame(rows, columns)).first()
    assert (row.selected_prediction_window_days, row.selected_feature_lookback_days, row.selected_propensity_model_name) == (30, 90, "a")


@pytest.fixture(scope="module")
def model_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        frequency = float(rng.integers(0, 6))
        buys = float(rng.random() < 1 / (1 + np.exp(-(frequency - 2.5))))
        rows.append(
            (f"u{i}", f"2021-{i % 12 + 1:02d}-01", ["France", "Spain", "Italy"][i % 3], float(rng.integers(0, 90)), frequency / 2,
             frequency * 5, frequency, frequency * 10, 10.0, buys, buys * (20 + 10 * frequency))
        )
    names = "user_id string, as_of_date string, country string, recency_days double, frequency_30d double, monetary_30d double, frequency_90d double, monetary_90d double, avg_basket_value_90d double, purchase_label double, revenue_label double"
    return prep.split_10_1_1(spark.createDataFrame(rows, names)).cache()


@pytest.mark.parametrize("name,rounds", [("logistic_regression", None), ("boosted_trees", 5)])
def test_calibrated_model_ranks_and_survives_saving(spark, model_rows, tmp_path, name, rounds):
    fit, score = model_rows.filter("slice = 'train'"), model_rows.filter("slice <> 'train'")
    model = models.fit_calibrated(fit, name, 90, max_iter=rounds)
    scored = model.transform(score).cache()
    assert scored.filter(~F.col("propensity_score").between(0, 1)).count() == 0
    assert metrics.roc_auc(scored, "purchase_label", "propensity_score").first()[0] > 0.7
    model.save(str(tmp_path / name))
    again = models.CalibratedPropensity.load(spark, str(tmp_path / name)).transform(score)
    # exp() may differ in its last bit before and after it is compiled, so the scores are compared with a tolerance.
    before, after = ({r.user_id: r.propensity_score for r in df.collect()} for df in (scored, again))
    assert after == pytest.approx(before, abs=1e-12)


def test_country_not_seen_in_training_is_scored(spark, model_rows):
    fitted = prep.feature_assembly(90).fit(model_rows)
    stranger = model_rows.limit(1).withColumn("country", F.lit("Atlantis"))
    vector = fitted.transform(stranger).first().features
    assert vector.size == 6 + 3 and vector.toArray()[6:].sum() == 0


def test_conditional_revenue_paths(model_rows):
    fit, score = model_rows.filter("slice = 'train'"), model_rows.filter("slice = 'test'")
    model = models.fit_conditional_revenue(fit, 90, max_iter=3)
    assert model.name == "gbt" and model.transform(score).filter("predicted_conditional_revenue < 0").count() == 0
    one = fit.filter("purchase_label = 1").limit(1)
    constant = models.fit_conditional_revenue(one, 90)
    assert constant.name == "constant" and constant.transform(score).first().predicted_conditional_revenue == one.first().revenue_label
    with pytest.raises(ValueError):
        models.fit_conditional_revenue(fit.filter("purchase_label = 0"), 90)
    assert models.revenue_fallback_mean(fit.filter("purchase_label = 0")).first()[0] is None


def test_one_class_is_rejected(model_rows):
    with pytest.raises(ValueError):
        models.fit_calibrated(model_rows.filter("purchase_label = 0"), "logistic_regression", 90)
    with pytest.raises(ValueError):
        models.fit_base_model("forest", model_rows, 90)


def test_one_class_becomes_a_row_and_other_failures_stop_the_sweep(spark, model_rows):
    panel = model_rows.selectExpr("*", "purchase_label AS label_purchase_30d", "revenue_label AS label_net_revenue_30d").drop("purchase_label", "revenue_label", "slice")

    def breaks(fit, score, lookback):
        raise RuntimeError("no model")

    one_class = panel.filter("label_purchase_30d = 0")
    row = sensitivity.window_sweep(one_class, {"logistic_regression": breaks}, horizons=(30,), lookbacks=(90,)).first()
    assert (row.status, row.average_precision) == ("invalid", 0.0) and "contrast" in row.error

    with pytest.raises(RuntimeError, match="no model"):
        sensitivity.window_sweep(panel, {"logistic_regression": breaks}, horizons=(30,), lookbacks=(90,))


def test_the_sweep_holds_no_copy_of_the_panel(model_rows):
    panel = model_rows.selectExpr("*", "purchase_label AS label_purchase_30d", "revenue_label AS label_net_revenue_30d").drop("purchase_label", "revenue_label", "slice")
    panel, plans = stored(panel), []

    def scorer(fit, score, lookback):
        plans.append(fit._jdf.queryExecution().withCachedData().toString())
        return score.withColumn("propensity_score", F.lit(0.5))

    row = sensitivity.window_sweep(panel, {"logistic_regression": scorer}, horizons=(30,), lookbacks=(90,)).first()
    slices = dict(prep.split_10_1_1(panel).groupBy("slice").count().collect())
    assert (row.status, row.train_rows, row.validation_rows) == ("ok", slices["train"], slices["validation"])
    assert len(plans) == 1 and "InMemoryRelation" not in plans[0]
