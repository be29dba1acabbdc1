"""Purchase-gap diagnostics and the window sweep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.functions.columns import has_user, round_half_away
from bazaarflow.operators import metrics
from bazaarflow.operators.boosting import SteppedTrees
from bazaarflow.operators.models import calibrated_scores
from bazaarflow.operators.prep import OneClassError, apply_spend_cap, require_two_classes, spend_cap_value, split_10_1_1, training_rows
from bazaarflow.schemas import HORIZONS, LOOKBACKS, PROPENSITY_MODELS

# (fit rows, score rows, lookback) -> score rows with propensity_score
Scorer = Callable[[DataFrame, DataFrame, int], DataFrame]
Pair = tuple[int, int]  # horizon, lookback
SWEEP_LOOKBACK = 90
SWEEP_HORIZON = 30


def inter_purchase_gaps(silver: DataFrame) -> DataFrame:
    """Days between a user's consecutive purchase days.

    Lines shrink to distinct user days first, so one user's window never holds more rows than there are calendar days.
    """
    days = silver.filter(has_user() & (F.col("quantity") > 0)).select("user_id", "event_date").distinct()
    previous = F.lag("event_date").over(Window.partitionBy("user_id").orderBy("event_date"))
    gaps = days.withColumn("gap_days", F.date_diff(F.col("event_date"), previous))
    return gaps.filter(F.col("gap_days") > 0)


def _gap_histogram(gaps: DataFrame) -> DataFrame:
    """Rows per gap length: bounded by the calendar, however many gaps there are."""
    return gaps.groupBy("gap_days").agg(F.count(F.lit(1)).alias("rows"))


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """Count, mean and upper median of the gaps; the last two are NULL when there are none."""
    histogram = _gap_histogram(gaps)
    shape = histogram.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("gap_observation_count"),
        F.sum(F.col("gap_days").cast("bigint") * F.col("rows")).alias("total_days"),
        F.array_sort(F.collect_list(F.struct("gap_days", "rows"))).alias("cells"),
    )
    # Walk up the sorted cells until more than half of the gaps are covered.
    middle = F.floor(F.col("gap_observation_count") / 2)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("median"))
    walked = F.aggregate(
        "cells",
        start,
        lambda acc, cell: F.struct(
            (acc["seen"] + cell["rows"]).alias("seen"),
            F.when(acc["seen"] <= middle, cell["gap_days"]).otherwise(acc["median"]).alias("median"),
        ),
    )
    mean = F.try_divide(F.col("total_days").cast("double"), F.col("gap_observation_count"))
    return shape.select(
        "gap_observation_count", walked["median"].alias("median_gap_days"), round_half_away(mean, 6).alias("mean_gap_days")
    )


def gap_coverage(gaps: DataFrame, windows: Sequence[int] = HORIZONS) -> DataFrame:
    """Share of gaps no longer than each window; no rows when there are no gaps."""
    shares = _gap_histogram(gaps).agg(
        F.sum("rows").alias("all_rows"),
        *(F.sum(F.when(F.col("gap_days") <= w, F.col("rows")).otherwise(0)).alias(f"within_{w}") for w in windows),
    )
    cells = F.array(
        *(
            F.struct(F.lit(w).alias("window_days"), (F.col(f"within_{w}") / F.col("all_rows")).alias("share"))
            for w in windows
        )
    )
    covered = shares.filter(F.col("all_rows") > 0).select(F.inline(cells))
    return covered.select("window_days", round_half_away(F.col("share"), 6).alias("inter_purchase_gap_coverage"))


def trained_scorers(names: Sequence[str] = PROPENSITY_MODELS, max_iter: int | None = None) -> dict[str, Scorer | SteppedTrees]:
    """The calibrated models for the sweep. The trees of all windows are grown in step, as one fit after the other would
    take a job per level of every tree of every fit."""

    def scorer(name: str) -> Scorer | SteppedTrees:
        if name == "boosted_trees":
            return SteppedTrees(300 if max_iter is None else max_iter)
        return lambda fit, score, lookback: calibrated_scores(fit, score, name, lookback)

    return {name: scorer(name) for name in names}


SWEEP_SCHEMA = (
    "sweep string, window_days int, model_order int, model_name string, status string, roc_auc double, "
    "average_precision double, top_decile_lift double, brier_score double, ece_10_bin double, train_rows bigint, "
    "validation_rows bigint, positive_rate_validation double, spend_cap_value double, error string"
)


def _prepared(panel: DataFrame, horizon: int, lookback: int) -> tuple[DataFrame, float, dict[str, int]] | OneClassError:
    """Capped rows with the cap and the rows per slice, or what is wrong with the labels."""
    try:
        rows = split_10_1_1(training_rows(panel, horizon, lookback))
        train = rows.filter("slice = 'train'")
        require_two_classes(train)
        cap = spend_cap_value(train, lookback).first()[0]
        return apply_spend_cap(rows, lookback, cap), cap, dict(rows.groupBy("slice").count().collect())
    except OneClassError as error:
        return error


def _invalid(name: str, error: OneClassError) -> tuple:
    return (name, "invalid", 0.0, 0.0, 0.0, 1.0, 1.0, 0, 0, 0.0, 0.0, f"{type(error).__name__}: {error}"[:500])


def _quality(name: str, counts: Mapping[str, int], cap: float, scored: DataFrame) -> tuple:
    scored = scored.persist()
    values = dict(metrics.propensity_quality(scored, "purchase_label", "propensity_score").collect())
    scored.unpersist()
    return (
        name,
        "ok",
        values["roc_auc"],
        values["average_precision"],
        values["top_decile_lift"],
        values["brier_score"],
        values["ece_10_bin"],
        counts.get("train", 0),
        counts.get("validation", 0),
        values["base_positive_rate"],
        round(cap, 6),
        None,
    )


def window_sweep(
    panel: DataFrame,
    models: Mapping[str, Scorer | SteppedTrees],
    horizons: Sequence[int] = HORIZONS,
    lookbacks: Sequence[int] = LOOKBACKS,
) -> DataFrame:
    """Horizons at the fixed lookback, then lookbacks at the fixed horizon, each with every model.

    The handful of combinations is prepared, fitted and measured side by side; models that fit all of them at once do so.
    Labels of one class become an ``invalid`` row. Every combination reads its own few columns of the panel, several times:
    pass a stored one. No copy of it is held in memory, neither of the panel nor of the rows of a combination.
    """
    plan = [("horizon", h, h, SWEEP_LOOKBACK) for h in horizons] + [("lookback", b, SWEEP_HORIZON, b) for b in lookbacks]
    pairs = list(dict.fromkeys((horizon, lookback) for _, _, horizon, lookback in plan))
    on_session = inheritable_thread_target(panel.sparkSession)
    with ThreadPool(4) as pool:
        prepared = dict(zip(pairs, pool.starmap(on_session(lambda h, b: _prepared(panel, h, b)), pairs), strict=True))
        usable = {pair: found for pair, found in prepared.items() if not isinstance(found, OneClassError)}
        joint = {n: m.scores({pair: found[0] for pair, found in usable.items()}) for n, m in models.items() if isinstance(m, SteppedTrees) and usable}

        def evaluated(name: str, pair: Pair) -> tuple:
            if pair not in usable:
                return _invalid(name, prepared[pair])
            capped, cap, counts = usable[pair]
            try:
                if name in joint:
                    return _quality(name, counts, cap, joint[name][pair])
                return _quality(name, counts, cap, models[name](capped.filter("slice = 'train'"), capped.filter("slice = 'validation'"), pair[1]))
            except OneClassError as error:
                return _invalid(name, error)

        tasks = [(name, pair) for pair in pairs for name in models]
        done = dict(zip(tasks, pool.starmap(on_session(evaluated), tasks), strict=True))
    result = [(sweep, window, order, *done[name, (h, b)]) for sweep, window, h, b in plan for order, name in enumerate(models)]
    return panel.sparkSession.createDataFrame(result, SWEEP_SCHEMA)


def freeze_decision(sweep: DataFrame) -> DataFrame:
    """Best horizon and best lookback, chosen separately by average precision; on a tie the first window, then model.

    The model is the one that is best at the chosen lookback.
    """

    def best(kind: str):
        rank = F.struct(
            "average_precision",
            (-F.col("window_days")).alias("w"),
            (-F.col("model_order")).alias("m"),
            "window_days",
            "model_name",
        )
        return F.max(F.when(F.col("sweep") == kind, rank))

    chosen = sweep.agg(best("horizon").alias("h"), best("lookback").alias("b"))
    return chosen.select(
        F.col("h.window_days").alias("selected_prediction_window_days"),
        F.col("b.window_days").alias("selected_feature_lookback_days"),
        F.col("b.model_name").alias("selected_propensity_model_name"),
        F.col("h.model_name").alias("prediction_window_model"),
        round_half_away(F.col("h.average_precision"), 6).alias("prediction_window_average_precision"),
        F.col("b.model_name").alias("lookback_model"),
        round_half_away(F.col("b.average_precision"), 6).alias("lookback_average_precision"),
    )
