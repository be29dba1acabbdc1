"""Gates over finished runs: one row ``(check, passed, detail)`` per rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.schemas import HORIZONS, POLICIES, PROPENSITY_MODELS, RETRIEVERS


def _check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One rule as one aggregated row; a rule that cannot be judged has failed."""
    row = df.agg(F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))
    return row.select(F.lit(name).alias("check"), "passed", F.coalesce("detail", F.lit("missing")).alias("detail"))


def _stack(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def _value(of: Column, where: Column) -> Column:
    return F.max(F.when(where, of))


def validate_propensity_outputs(
    model_name: str,
    metrics: DataFrame,
    policies_validation: DataFrame,
    policies_test: DataFrame,
    sweep: DataFrame | None = None,
    expect_sweep: bool = False,
) -> DataFrame:
    """Rules for a propensity run: ``metrics`` is ``(slice, metric, value)``, the policies are comparison tables."""
    probabilities = F.col("metric").isin("roc_auc", "average_precision") & (F.col("slice") == "validation")
    in_bounds = F.count_if(probabilities & F.col("value").between(0.0, 1.0)) == 2
    revenue, policy = F.col("actual_revenue_per_targeted_user"), F.col("policy")
    ml, rnd = _value(revenue, policy == "ml_top_expected_value"), _value(revenue, policy == "random_baseline")
    both = policies_validation.select(F.lit("validation").alias("slice"), "policy").unionByName(
        policies_test.select(F.lit("test").alias("slice"), "policy")
    )
    expected = len(POLICIES)
    rows_of = {name: F.count_if(F.col("slice") == name) for name in ("validation", "test")}
    is_ml = policy == "ml_top_expected_value"
    users, spend = _value(F.col("targeted_users"), is_ml), _value(F.col("budget_spend"), is_ml)
    checks = [
        _check(
            metrics.limit(1),
            "selected_model_valid",
            F.lit(model_name in PROPENSITY_MODELS),
            F.lit(f"selected_model_name={model_name}"),
        ),
        _check(
            metrics,
            "candidate_metrics_in_bounds",
            in_bounds,
            F.concat(F.lit("metrics="), F.count_if(probabilities).cast("string")),
        ),
        _check(
            policies_test,
            "ml_beats_random_revenue_per_user",
            ml >= rnd,
            F.concat(F.lit("ml="), ml.cast("string"), F.lit(", random="), rnd.cast("string")),
        ),
        _check(
            both,
            "budget_policies_in_both_slices",
            (rows_of["validation"] == expected) & (rows_of["test"] == expected),
            F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in rows_of.items())),
        ),
        _check(
            policies_test,
            "budget_policy_selection_nonzero",
            (users > 0) & (spend > 0),
            F.concat(F.lit("targeted_users="), users.cast("string"), F.lit(", budget_spend="), spend.cast("string")),
        ),
    ]
    if expect_sweep:
        if sweep is None:
            raise ValueError("a window sweep is required")
        windows = F.array_sort(F.collect_set(F.when(F.col("sweep") == "horizon", F.col("window_days"))))
        checks.append(
            _check(
                sweep,
                "window_sweep_has_all_horizons",
                windows == F.array(*(F.lit(h) for h in HORIZONS)),
                F.concat(F.lit("windows="), windows.cast("string")),
            )
        )
    return _stack(checks)


def validate_recommender_outputs(
    selected: DataFrame, metrics: DataFrame, topk: DataFrame, item_embeddings: DataFrame
) -> DataFrame:
    """Rules for a recommender run. ``selected`` is the one-row winner, the rest are its metric and serving tables."""
    winner = selected.select("selected_model_name").scalar()
    grid = F.collect_set(F.concat_ws("/", "model_name", "split"))
    wanted = F.array(*(F.lit(f"{m}/{s}") for m in sorted(RETRIEVERS) for s in ("test", "validation")))
    values = ("recall_at_20", "ndcg_at_20", "hit_rate_at_20")
    inside = reduce(lambda a, b: a & b, (F.col(v).between(0.0, 1.0) for v in values))
    return _stack(
        [
            _check(
                selected,
                "selected_model_present",
                F.max("selected_model_name").isin(*RETRIEVERS),
                F.concat(F.lit("selected_model_name="), F.max("selected_model_name")),
            ),
            _check(
                metrics,
                "all_models_in_both_slices",
                F.array_sort(grid) == F.array_sort(wanted),
                F.concat(F.lit("rows="), F.count(F.lit(1)).cast("string")),
            ),
            _check(metrics, "metrics_in_bounds", F.every(inside), F.lit("all metrics checked")),
            _check(
                topk,
                "topk_recommendations_non_empty",
                F.count(F.lit(1)) > 0,
                F.concat(F.lit("row_count="), F.count(F.lit(1)).cast("string")),
            ),
            _check(
                topk.withColumn("winner", winner),
                "topk_model_matches_selection",
                F.every(F.col("model_name") == F.col("winner")),
                F.concat(F.lit("topk_model="), F.max("model_name")),
            ),
            _check(
                item_embeddings.withColumn("winner", winner),
                "embedding_table_matches_selection",
                F.every(F.col("model_name") == F.col("winner")),
                F.concat(F.lit("embedding_model="), F.max("model_name")),
            ),
            _check(
                item_embeddings,
                "retrieval_table_present",
                (F.count(F.lit(1)) > 0) & (F.min(F.size("vector")) > 0),
                F.concat(F.lit("items="), F.count(F.lit(1)).cast("string")),
            ),
        ]
    )


def require_valid(checks: DataFrame) -> DataFrame:
    """Return the checks, or fail with the rules that are broken."""
    failed = [f"{row['check']} ({row['detail']})" for row in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"Output validation failed: {failed}")
    return checks


def propensity_kpis(metrics: DataFrame, policies_validation: DataFrame, policies_test: DataFrame) -> DataFrame:
    """Headline numbers of a propensity run as ``(area, kpi, value)``."""
    headline = ("roc_auc", "average_precision", "top_decile_lift", "brier_score", "ece_10_bin")
    quality = metrics.filter((F.col("slice") == "validation") & F.col("metric").isin(*headline)).select(
        F.lit("model").alias("area"), F.col("metric").alias("kpi"), "value"
    )
    outcomes = [
        policies.select(
            F.lit(f"policy_{name}").alias("area"),
            F.concat(F.col("policy"), F.lit("_revenue_per_user")).alias("kpi"),
            F.col("actual_revenue_per_targeted_user").alias("value"),
        )
        for name, policies in (("validation", policies_validation), ("test", policies_test))
    ]
    return _stack([quality, *outcomes])


def recommender_kpis(anchored: DataFrame) -> DataFrame:
    """Recall and lift over the random anchor per model and slice as ``(area, kpi, value)``."""
    cells = F.array(
        F.struct(F.concat(F.col("model_name"), F.lit("_recall_at_20")).alias("kpi"), F.col("recall_at_20").alias("value")),
        F.struct(F.concat(F.col("model_name"), F.lit("_lift_over_random")).alias("kpi"), F.col("lift").alias("value")),
    )
    return anchored.select(F.col("split").alias("area"), F.inline(cells))


def interpretation_kpis(propensity: DataFrame | None = None, recommender: DataFrame | None = None) -> DataFrame:
    """Both reports' headline numbers in one table; a run of one engine alone gives its own half."""
    if propensity is None and recommender is None:
        raise ValueError("there is no report to take headline numbers from")
    parts = [
        part.select(F.lit(name).alias("report"), "area", "kpi", "value")
        for name, part in (("propensity", propensity), ("recommender", recommender))
        if part is not None
    ]
    return _stack(parts)
