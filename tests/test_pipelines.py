"""Both engines end to end on a synthetic shop, their parameter rules and their gates."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bazaarflow.operators import silver, validate
from bazaarflow.plans import registry
from bazaarflow.plans.propensity import propensity_pipeline
from bazaarflow.plans.recommender import recommender_pipeline
from bazaarflow.schemas import RAW_SCHEMA
from bazaarflow.sources import writers


def shop_lines():
    """80 users, one product each, monthly purchases with a few irregular ones and three outliers."""
    monthly = ["2010-12-10", "2011-01-10", "2011-02-10", "2011-03-10", "2011-04-10", "2011-05-10", "2011-06-10", "2011-07-10", "2011-08-20", "2011-09-10", "2011-10-10"]
    out = []

    def add(i, day, quantity, price):
        country = "United Kingdom" if i % 2 == 0 else "France"
        out.append((str(len(out) + 1), f"SKU{i:04d}", "Gift Item", str(quantity), f"{day} 10:00:00", str(price), f"{10000 + i}.0", country))

    for i in range(1, 81):
        for day in monthly:
            add(i, day, 2 if day == "2011-07-10" else 1, 8.0 + i % 7)
        if i % 2 == 0:
            add(i, "2011-11-10", 1, 14.0)
            add(i, "2011-10-20", 1, 18.0)
        if i <= 3:
            add(i, "2011-10-25", 1, 5000.0)
        if i % 4 in (0, 1):
            add(i, "2011-09-25", 1, 20.0)
        if i % 5 == 0:
            add(i, "2011-10-25", 1, 25.0)
        if i % 6 == 0:
            add(i, "2011-11-20", 1, 30.0)
        if i % 3 == 0:
            add(i, "2011-11-25", 1, 35.0)
    return out


@pytest.fixture(scope="module")
def shop(spark):
    return silver.silver_transactions(spark.createDataFrame(shop_lines(), RAW_SCHEMA)).cache()


def test_propensity_engine(spark, shop, tmp_path):
    run = propensity_pipeline(
        shop, "2011-11-10", mode="fixed", model="logistic_regression", horizon=30, lookback=90, budget=500, cost=5, revenue_iter=3
    )
    assert run.spend_cap > 0 and run.model_name == "logistic_regression"
    values = {(r.slice, r.metric): r.value for r in run.metrics.collect()}
    assert values["validation", "top_decile_lift"] > 0 and values["test", "top_decile_lift"] > 0
    assert values["test", "rows"] > 0
    for policies in (run.policies_validation, run.policies_test):
        assert {r.policy for r in policies.collect()} == {"ml_top_expected_value", "random_baseline", "rfm_heuristic"}
    assert run.scored_test.filter(~F.col("propensity_score").between(0, 1)).count() == 0
    checks = {r.check: r.passed for r in run.checks.collect()}
    assert checks["selected_model_valid"] and checks["candidate_metrics_in_bounds"] and checks["budget_policy_selection_nonzero"]
    assert run.kpis.filter("report = 'propensity'").count() == 11
    written = writers.predictions_csv_sink(run.scored_test, str(tmp_path / "scores"), 30)
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == written.columns


def test_sensitivity_mode_freezes_a_choice(shop):
    run = propensity_pipeline(shop, "2011-11-10", mode="sensitivity", budget=500, cost=5, max_iter=1, revenue_iter=1, candidates=("boosted_trees",))
    sweep = run.sweep.collect()
    assert {r.window_days for r in sweep if r.sweep == "horizon"} == {30, 60, 90}
    assert {r.window_days for r in sweep if r.sweep == "lookback"} == {60, 90, 120}
    assert len(sweep) == 6 and run.model_name == "boosted_trees"
    assert run.checks.filter("check = 'window_sweep_has_all_horizons'").first().passed


@pytest.mark.parametrize(
    "changes",
    [{"horizon": 45}, {"lookback": 30}, {"lookback": 150}, {"model": None}, {"model": "forest"}, {"mode": "auto"}, {"budget": 0}, {"cost": -1}, {"budget": 1}],
)
def test_bad_parameters_are_rejected_before_any_work(changes):
    arguments = {"mode": "fixed", "model": "logistic_regression", "horizon": 30, "lookback": 90, "budget": 5000, "cost": 5, **changes}
    with pytest.raises(ValueError):
        propensity_pipeline(None, "2011-11-09", **arguments)


def policies(spark, names=("ml_top_expected_value", "random_baseline", "rfm_heuristic"), users=100, spend=500.0):
    rows = [(n, r, users, spend) for n, r in zip(names, (10.0, 5.0, 9.0))]
    return spark.createDataFrame(rows, "policy string, actual_revenue_per_targeted_user double, targeted_users int, budget_spend double")


def quality(spark, auc=0.7, ap=0.5):
    return spark.createDataFrame([("validation", "roc_auc", auc), ("validation", "average_precision", ap)], "slice string, metric string, value double")


def sweep(spark, windows=(30, 60, 90)):
    return spark.createDataFrame([("horizon", w) for w in windows], "sweep string, window_days int")


def test_propensity_gate_passes(spark):
    checks = validate.validate_propensity_outputs(
        "logistic_regression", quality(spark), policies(spark), policies(spark), sweep(spark), expect_sweep=True
    )
    assert checks.count() == 6 and checks.filter("NOT passed").count() == 0


@pytest.mark.parametrize(
    "broken",
    [
        {"model": "forest"},
        {"auc": 1.2},
        {"ap": -0.1},
        {"names": ("ml_top_expected_value", "random_baseline")},
        {"users": 0},
        {"spend": 0.0},
        {"windows": (30, 60)},
    ],
)
def test_propensity_gate_fails(spark, broken):
    metrics = quality(spark, broken.get("auc", 0.7), broken.get("ap", 0.5))
    names = broken.get("names", ("ml_top_expected_value", "random_baseline", "rfm_heuristic"))
    table = policies(spark, names, broken.get("users", 100), broken.get("spend", 500.0))
    checks = validate.validate_propensity_outputs(
        broken.get("model", "logistic_regression"), metrics, policies(spark), table, sweep(spark, broken.get("windows", (30, 60, 90))), True
    )
    with pytest.raises(ValueError):
        validate.require_valid(checks)


@pytest.fixture(scope="module")
def baskets(spark):
    """Users buy from one of three product groups, several products per invoice."""
    rows = []
    for u in range(60):
        for n in range(5):
            for j in range(4):
                item = (u % 3) * 20 + (u * 7 + n * 5 + j * 3) % 20
                rows.append((f"{u}-{n}", f"P{item:03d}", "x", "1", f"2011-0{n + 1}-1{u % 9} 10:00:00", "2.0", f"{u}", "France"))
    return silver.silver_transactions(spark.createDataFrame(rows, RAW_SCHEMA)).cache()


def test_recommender_engine(baskets):
    run = recommender_pipeline(baskets, "2011-01-10", "2011-05-18", top_k=5, components=6, rank=6)
    assert run.checks.filter("NOT passed").count() == 0
    assert run.metrics.count() == 6 and run.model_name in ("popularity", "mf", "learned")
    topk = run.topk.collect()
    assert {r.model_name for r in topk} == {run.model_name}
    seen = {
        (r.user_id, r.item_id) for r in run.gold.split_rows.filter("split = 'train'").select("user_id", "item_id").collect()
    }
    assert not seen & {(r.user_id, r.item_id) for r in topk}
    per_user: dict[str, list] = {}
    for row in topk:
        per_user.setdefault(row.user_id, []).append((row["rank"], row.score))
    assert len(per_user) == 60
    for ranks in per_user.values():
        assert [r for r, _ in sorted(ranks)] == list(range(1, 6))
        scores = [s for _, s in sorted(ranks)]
        assert scores == sorted(scores, reverse=True)
    # tastes are grouped, so a factor model must beat popularity
    assert run.model_name != "popularity"


def test_recommender_rejects_bad_windows(baskets):
    with pytest.raises(ValueError):
        recommender_pipeline(baskets, "2011-05-18", "2011-01-10")
    with pytest.raises(ValueError):
        recommender_pipeline(baskets, "2011-01-10", "2011-05-18", top_k=0)


def test_manifest_counts(spark, shop, tmp_path):
    manifest = writers.run_manifest({"silver": shop}, {"panel_end_date": "2011-11-10"}, {"raw_total_rows": 3}, str(tmp_path / "m"))
    row = manifest.first()
    assert (row.artifact, row.rows, row.params["panel_end_date"], row.quality["raw_total_rows"]) == ("silver", shop.count(), "2011-11-10", 3.0)
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_interpretation_has_the_numbers_of_both_reports(spark, monkeypatch):
    rows = [("mf", part, 5, 0.3, 0.1, 0.2) for part in ("validation", "test")]
    lists = spark.createDataFrame(rows, "model_name string, split string, eligible_users bigint, recall_at_20 double, ndcg_at_20 double, hit_rate_at_20 double")
    quality = spark.createDataFrame([("validation", "roc_auc", 0.7), ("test", "roc_auc", 0.6)], "slice string, metric string, value double")
    policies = spark.createDataFrame([("rfm_heuristic", 9.0)], "policy string, actual_revenue_per_targeted_user double")
    monkeypatch.setattr(registry, "_gold", lambda s, sf: SimpleNamespace(n_items=200))
    monkeypatch.setattr(registry, "_popular_metrics", lambda gold: lists)
    monkeypatch.setattr(registry, "_stand_in_results", lambda s, sf: (quality, policies, policies))
    found = {tuple(r) for r in registry.all_queries()["interpretation_kpis"](spark, "").collect()}
    assert found == {
        ("propensity", "model", "roc_auc", 0.7),
        ("propensity", "policy_validation", "rfm_heuristic_revenue_per_user", 9.0),
        ("propensity", "policy_test", "rfm_heuristic_revenue_per_user", 9.0),
        *(("recommender", part, kpi, value) for part in ("validation", "test") for kpi, value in (("mf_recall_at_20", 0.3), ("mf_lift_over_random", 3.0))),
    }
    with pytest.raises(ValueError):
        validate.interpretation_kpis()
