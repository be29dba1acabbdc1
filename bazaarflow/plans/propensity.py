"""The propensity job: panel, models, policies and gates on one frozen panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.scale import cut_lineage, stored
from bazaarflow.operators import dq, labels, metrics, models, policy, prep, sensitivity, validate
from bazaarflow.schemas import PROPENSITY_MODELS, check_windows

MODES = ("sensitivity", "fixed")


@dataclass
class PropensityRun:
    model_name: str
    horizon: int
    lookback: int
    spend_cap: float
    scored_validation: DataFrame
    scored_test: DataFrame
    policies_validation: DataFrame
    policies_test: DataFrame
    metrics: DataFrame
    checks: DataFrame
    kpis: DataFrame
    sweep: DataFrame | None
    propensity: models.CalibratedPropensity
    revenue: models.ConditionalRevenue


def _with_policy_scores(scored: DataFrame, horizon: int, lookback: int) -> DataFrame:
    """All policy scores and the horizon-named label columns of the prediction table."""
    scored = policy.expected_value_score(scored)
    scored = policy.rfm_policy_score(policy.random_policy_score(scored), lookback)
    return scored.withColumns(
        {
            f"label_purchase_{horizon}d": F.col("purchase_label"),
            f"label_net_revenue_{horizon}d": F.col("revenue_label"),
            f"predicted_conditional_revenue_{horizon}d": F.col("predicted_conditional_revenue"),
        }
    )


def propensity_pipeline(
    silver: DataFrame,
    panel_end: date | str,
    mode: str = "fixed",
    model: str | None = None,
    horizon: int = 30,
    lookback: int = 90,
    budget: float = 5000.0,
    cost: float = 5.0,
    max_iter: int | None = None,
    revenue_iter: int = 200,
    candidates: Sequence[str] = PROPENSITY_MODELS,
) -> PropensityRun:
    """Run the whole propensity engine.

    ``fixed`` trains the given model; ``sensitivity`` first sweeps horizons, lookbacks and ``candidates`` and freezes the best.
    """
    if mode not in MODES:
        raise ValueError(f"{mode} is no mode of this engine; it runs as {MODES}")
    if mode == "fixed" and model is None:
        raise ValueError("a run with fixed windows needs the name of its model")
    if model is not None and model not in PROPENSITY_MODELS:
        raise ValueError(f"there is no propensity model named {model}; known are {PROPENSITY_MODELS}")
    check_windows(horizon, lookback)
    policy.target_count(budget, cost)

    panel = stored(labels.propensity_panel(silver, panel_end))
    dq.require_passed(dq.dq_report(dq.dq_train_duplicates(panel)))
    sweep = None
    if mode == "sensitivity":
        sweep = sensitivity.window_sweep(panel, sensitivity.trained_scorers(candidates, max_iter))
        chosen = sensitivity.freeze_decision(sweep).first()
        horizon, lookback = chosen["selected_prediction_window_days"], chosen["selected_feature_lookback_days"]
        model = chosen["selected_propensity_model_name"]

    rows = prep.split_10_1_1(prep.training_rows(panel, horizon, lookback))
    train = rows.filter("slice = 'train'")
    prep.require_two_classes(train)
    cap = prep.spend_cap_value(train, lookback).first()[0]
    # Written once: every fit below reads these rows again.
    rows = cut_lineage(prep.apply_spend_cap(rows, lookback, cap))
    iterations = max_iter if model == "boosted_trees" else None

    slices = {"validation": "slice = 'train'", "test": "slice <> 'test'"}

    def propensity_of(part: str):
        return lambda: models.fit_calibrated(rows.filter(slices[part]), model, lookback, max_iter=iterations)

    def revenues():
        first = models.fit_conditional_revenue(rows.filter(slices["validation"]), lookback, "gbt", revenue_iter)
        # The revenue model type is frozen by the validation stage.
        return first, models.fit_conditional_revenue(rows.filter(slices["test"]), lookback, first.name, revenue_iter)

    first_propensity, propensity, (first_revenue, revenue) = models.side_by_side(
        rows.sparkSession, propensity_of("validation"), propensity_of("test"), revenues
    )

    def scored(part: str, chance: models.CalibratedPropensity, spend: models.ConditionalRevenue) -> DataFrame:
        found = spend.transform(chance.transform(rows.filter(F.col("slice") == part)))
        return cut_lineage(_with_policy_scores(found, horizon, lookback))

    scored_validation = scored("validation", first_propensity, first_revenue)
    scored_test = scored("test", propensity, revenue)

    policies = [cut_lineage(policy.policy_comparison(s, budget, cost, horizon)) for s in (scored_validation, scored_test)]
    settings = {
        "spend_cap_value": cap,
        "revenue_fallback_value": revenue.fallback,
        "prediction_window_days": horizon,
        "feature_lookback_days": lookback,
    }
    table = cut_lineage(
        metrics.train_metrics_table(scored_validation, scored_test, rows.filter("slice = 'train'"), settings)
    )
    checks = validate.validate_propensity_outputs(model, table, *policies, sweep, expect_sweep=mode == "sensitivity")
    kpis = validate.interpretation_kpis(propensity=validate.propensity_kpis(table, *policies))
    return PropensityRun(
        model, horizon, lookback, cap, scored_validation, scored_test, *policies, table, checks, kpis, sweep, propensity, revenue
    )
