"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Dates and timestamps leave as ISO text, computed doubles are rounded where two engines may differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.functions.columns import normalize_user_id, round_half_away
from bazaarflow.functions.scale import cut_lineage, ensure_checkpoint_dir, stored
from bazaarflow.operators import (
    dq,
    embeddings,
    features,
    labels,
    metrics,
    models,
    policy,
    prep,
    ranking,
    retrieval,
    sensitivity,
    silver,
    splits,
    validate,
)
from bazaarflow.plans import propensity, recommender
from bazaarflow.plans.oracle import AS_OF, INTERACTIONS_FROM, INTERACTIONS_TO, PANEL_END
from bazaarflow.schemas import EVALUATION_K
from bazaarflow.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
SNAPSHOT = [date.fromisoformat(AS_OF)]
PANEL = features.month_anchors(PANEL_END)


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    shown = [
        F.col(f"`{f.name}`").cast("string").alias(f.name)
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return df.select(*shown)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch/{name}-{uuid4()}"


# --- shared inputs ------------------------------------------------------------------------------------------------
def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return readers.retail_lines(spark, sf)


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    return silver.silver_transactions(_raw(spark, sf))


def _asof(spark: SparkSession, sf: str) -> DataFrame:
    return features.asof_events(_silver(spark, sf), SNAPSHOT)


def _bought(spark: SparkSession, sf: str) -> DataFrame:
    return features.positive_events(_asof(spark, sf))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.labels_long(_silver(spark, sf), SNAPSHOT)


def _panel(spark: SparkSession, sf: str, months: int = len(PANEL)) -> DataFrame:
    return labels.propensity_panel(_silver(spark, sf), PANEL_END, months=months, check_bounds=False)


def _interactions(spark: SparkSession, sf: str) -> DataFrame:
    return splits.interaction_events(_silver(spark, sf), INTERACTIONS_FROM, INTERACTIONS_TO)


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.user_item_splits(_interactions(spark, sf))


# --- sources and sinks --------------------------------------------------------------------------------------------
def _raw_csv_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "raw-csv")
    _raw(spark, sf).write.options(**writers.CSV_OPTIONS).csv(path)
    return readers.raw_csv_source(spark, path)


def _parquet_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "silver")
    writers.parquet_sink(_silver(spark, sf), path)
    return plain(readers.parquet_source(spark, path, ("invoice_id", "item_id", "event_ts")))


def _snapshot_panel_source(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    writers.parquet_sink(_panel(spark, sf), path, partition_by="as_of_date")
    return plain(readers.read_panel(spark, path, PANEL[6:]))


def _snapshot_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A panel whose last snapshot is out of date, after that snapshot alone was made and written again."""
    path, last = scratch_path(spark, "panel"), F.col("as_of_date") == F.lit(PANEL[-1])
    clean = stored(_silver(spark, sf))
    panel = labels.propensity_panel(clean, PANEL_END, check_bounds=False)
    stale = panel.withColumn("monetary_90d", F.when(~last, F.col("monetary_90d")).otherwise(-1.0))
    writers.parquet_sink(stale, path, partition_by="as_of_date")
    fresh = labels.propensity_panel(clean, PANEL_END, months=1, check_bounds=False)
    writers.snapshot_sink(fresh, path, PANEL[-1:])
    return plain(readers.read_panel(spark, path, PANEL[6:]))


def _parquet_sink(spark: SparkSession, sf: str) -> DataFrame:
    rows = writers.parquet_sink(_silver(spark, sf), scratch_path(spark, "silver"))
    return spark.createDataFrame([("silver_transactions_line_items", rows)], "artifact string, rows bigint")


def _parquet_to_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    source, target = scratch_path(spark, "silver"), scratch_path(spark, "silver-csv")
    writers.parquet_sink(plain(_silver(spark, sf)), source)
    writers.parquet_to_csv_export(spark, source, target)
    return spark.read.options(header=True, multiLine=True, escape='"').csv(target)


def _run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    clean = cut_lineage(_silver(spark, sf))
    manifest = writers.run_manifest(
        {
            "silver_transactions_line_items": clean,
            "gold_labels": labels.labels_long(clean, PANEL),
            "gold_propensity_train_dataset": labels.propensity_panel(clean, PANEL_END),
        },
        {"panel_end_date": PANEL_END},
    )
    return manifest.select("artifact", "as_of_date", "rows")


def _normalize_user_id(spark: SparkSession, sf: str) -> DataFrame:
    raw_id = F.col("Customer ID")
    named = _raw(spark, sf).select(raw_id.alias("raw_user_id"), normalize_user_id(raw_id).alias("user_id"))
    return named.groupBy("raw_user_id", "user_id").agg(F.count(F.lit(1)).alias("line_count"))


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return silver.valid_lines(silver.typed_lines(_raw(spark, sf)))


def gold_queries() -> dict[str, Query]:
    """Sources, silver, propensity gold and recommender gold."""
    return {
        "raw_csv_source": _raw_csv_source,
        "parquet_source": _parquet_source,
        "snapshot_panel_source": _snapshot_panel_source,
        "parquet_sink": _parquet_sink,
        "snapshot_sink": _snapshot_sink,
        "parquet_to_csv_export": _parquet_to_csv_export,
        "run_manifest": _run_manifest,
        "raw_dedup": lambda s, sf: plain(silver.raw_dedup(_raw(s, sf))),
        "typed_lines": lambda s, sf: plain(silver.typed_lines(_raw(s, sf))),
        "normalize_user_id": _normalize_user_id,
        "valid_lines": lambda s, sf: plain(_valid(s, sf)),
        "silver_grain_agg": lambda s, sf: plain(silver.silver_grain_agg(_valid(s, sf))),
        "silver_transactions": lambda s, sf: plain(_silver(s, sf)),
        "silver_event_bounds": lambda s, sf: plain(silver.silver_event_bounds(_silver(s, sf))),
        "snapshot_dates": lambda s, sf: plain(features.snapshots_in_bounds(_silver(s, sf), PANEL_END)),
        "asof_events": lambda s, sf: plain(_asof(s, sf)),
        "positive_events": lambda s, sf: plain(_bought(s, sf)),
        "asof_users": lambda s, sf: plain(features.asof_users(_asof(s, sf))),
        "latest_event_per_user": lambda s, sf: plain(features.latest_event_per_user(_bought(s, sf))),
        "lookback_frequency": lambda s, sf: plain(features.lookback_frequency(_bought(s, sf))),
        "lookback_monetary": lambda s, sf: plain(features.lookback_monetary(_bought(s, sf))),
        "invoice_totals_windowed": lambda s, sf: plain(features.invoice_totals_windowed(_bought(s, sf))),
        "avg_basket_value": lambda s, sf: plain(
            features.avg_basket_value(features.invoice_totals_windowed(_bought(s, sf)))
        ),
        "user_features_asof": lambda s, sf: plain(features.user_features_asof(_silver(s, sf), PANEL)),
        "future_outcomes": lambda s, sf: plain(labels.future_outcomes(_silver(s, sf), PANEL)),
        "labels_long": lambda s, sf: plain(_labels(s, sf)),
        "labels_pivot": lambda s, sf: plain(labels.labels_pivot(_labels(s, sf))),
        "propensity_train_dataset": lambda s, sf: plain(
            labels.propensity_train_dataset(features.user_features_asof(_silver(s, sf), SNAPSHOT), _labels(s, sf))
        ),
        # Frozen: the check of the dates and the panel both read it.
        "propensity_panel": lambda s, sf: plain(labels.propensity_panel(cut_lineage(_silver(s, sf)), PANEL_END)),
        "interaction_events": _interactions,
        "invoice_moments": lambda s, sf: splits.invoice_moments(_interactions(s, sf)),
        "invoice_recency_rank": lambda s, sf: splits.invoice_recency_rank(splits.invoice_moments(_interactions(s, sf))),
        "user_item_splits": _splits,
        "user_index": lambda s, sf: splits.user_index(_splits(s, sf)),
        "item_index": lambda s, sf: splits.item_index(_splits(s, sf)),
    }


# --- data quality -------------------------------------------------------------------------------------------------
def _dq_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every verdict of the silver, propensity and recommender tables, each table written once."""
    clean = stored(_silver(spark, sf))
    split_rows = cut_lineage(splits.user_item_splits(splits.interaction_events(clean, INTERACTIONS_FROM, INTERACTIONS_TO)))
    return dq.dq_report(
        dq.dq_silver_duplicates(clean),
        dq.dq_feature_duplicates(features.user_features_asof(clean, PANEL)),
        dq.dq_invalid_labels(labels.labels_long(clean, PANEL)),
        dq.dq_train_duplicates(labels.propensity_panel(clean, PANEL_END, check_bounds=False)),
        dq.dq_truncated_horizons(clean, PANEL),
        dq.dq_invalid_split(split_rows),
        dq.dq_split_chronology(split_rows),
        dq.dq_split_chronology_strict(split_rows),
        dq.dq_index_contiguity(splits.user_index(split_rows), "user_id", "user_idx"),
        dq.dq_index_contiguity(splits.item_index(split_rows), "item_id", "item_idx"),
        dq.dq_window_in_bounds(clean, INTERACTIONS_FROM, INTERACTIONS_TO),
    )


def _column_presence(spark: SparkSession, sf: str) -> DataFrame:
    """The line table's own file schema against the columns the adapter reads."""
    own = spark.read.parquet(f"{sf}/lineitem.parquet")
    return dq.column_presence(own, readers.required_columns("lineitem"))


def dq_queries() -> dict[str, Query]:
    return {
        "dq_required_columns": _column_presence,
        "dq_bad_timestamp_ratio": lambda s, sf: dq.dq_bad_timestamp_ratio(_raw(s, sf)),
        "dq_silver_duplicates": lambda s, sf: dq.dq_silver_duplicates(_silver(s, sf)),
        "dq_feature_duplicates": lambda s, sf: dq.dq_feature_duplicates(
            features.user_features_asof(_silver(s, sf), PANEL)
        ),
        "dq_invalid_labels": lambda s, sf: dq.dq_invalid_labels(_labels(s, sf)),
        "dq_invalid_split": lambda s, sf: dq.dq_invalid_split(_splits(s, sf)),
        "dq_split_chronology": lambda s, sf: dq.dq_split_chronology(_splits(s, sf)),
        "dq_split_chronology_strict": lambda s, sf: dq.dq_split_chronology_strict(_splits(s, sf)),
        "dq_train_duplicates": lambda s, sf: dq.dq_train_duplicates(_panel(s, sf)),
        "dq_index_contiguity": lambda s, sf: dq.dq_index_contiguity(
            splits.user_index(_splits(s, sf)), "user_id", "user_idx"
        ),
        "dq_window_in_bounds": lambda s, sf: dq.dq_window_in_bounds(
            _silver(s, sf), INTERACTIONS_FROM, INTERACTIONS_TO
        ),
        "dq_report": _dq_report,
    }


# --- propensity: preparation, metrics, policies -------------------------------------------------------------------
HORIZON, LOOKBACK, BUDGET, COST = 30, 90, 1000.0, 5.0
REVENUE = f"predicted_conditional_revenue_{HORIZON}d"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return prep.training_rows(_panel(spark, sf), HORIZON, LOOKBACK)


def _sliced(spark: SparkSession, sf: str) -> DataFrame:
    """Sliced training rows, frozen because the slicing step already has to read the dates."""
    return prep.split_10_1_1(stored(_rows(spark, sf)))


def _capped(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    rows = _sliced(spark, sf)
    cap = prep.spend_cap_value(rows.filter("slice = 'train'"), LOOKBACK).first()[0]
    return prep.apply_spend_cap(rows, LOOKBACK, cap), cap


def _scored(spark: SparkSession, sf: str, months: int = len(PANEL)) -> DataFrame:
    """The panel's last snapshots with deterministic stand-in scores, so that metrics and policies have an exact expected result."""
    panel = _panel(spark, sf, months).withColumn("as_of_date", F.col("as_of_date").cast("string"))
    chance = round_half_away(F.lit(1.0) / (F.lit(1.0) + F.col("recency_days") / F.lit(30.0)), 6)
    scored = panel.withColumn("propensity_score", chance).withColumn(REVENUE, F.col("avg_basket_value_90d"))
    scored = policy.rfm_policy_score(policy.random_policy_score(policy.expected_value_score(scored, REVENUE)), LOOKBACK)
    last = {"test": PANEL[-1], "validation": PANEL[-2]}
    name = F.lit("train")
    for part, day in last.items():
        name = F.when(F.col("as_of_date") == str(day), part).otherwise(name)
    return scored.withColumn("slice", name)


def _metric(function) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(function(_scored(spark, sf), f"label_purchase_{HORIZON}d", "propensity_score"))

    return query


def rounded(df: DataFrame) -> DataFrame:
    """Every double at six decimals."""
    return df.select(
        *(
            round_half_away(F.col(f"`{f.name}`"), 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


def _apply_spend_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_capped(spark, sf)[0].select("user_id", "as_of_date", f"monetary_{LOOKBACK}d"))


def _country_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sliced(spark, sf).select("user_id", "as_of_date", "country", "slice")
    return prep.country_one_hot(rows.filter("slice = 'train'"), rows.drop("slice"))


def _country_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The set slot of each sparse vector, its value and the vector's size."""
    rows = _sliced(spark, sf).select("user_id", "as_of_date", "country", "slice")
    vocabulary, size = prep.country_vocabulary(rows.filter("slice = 'train'"))
    flags = models.vector_to_array("country_flags")
    return prep.country_vectors(rows.drop("slice"), vocabulary, size).select(
        "user_id",
        "as_of_date",
        (F.array_position(flags, F.lit(1.0)) - 1).alias("slot"),
        F.size(flags).cast("bigint").alias("slots"),
        F.aggregate(flags, F.lit(0.0), lambda total, flag: total + flag).alias("flags_set"),
    )


def _spend_cap_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the sketched cap's ranks reach the wanted one within the promised rank error."""
    train = cut_lineage(_sliced(spark, sf).filter("slice = 'train'"))
    spend, cap = F.col(f"monetary_{LOOKBACK}d"), prep.spend_cap_sketch(train, LOOKBACK).first()[0]
    counted = train.agg(
        F.count(spend).alias("train_rows"), F.count_if(spend < cap).alias("below"), F.count_if(spend <= cap).alias("up_to")
    )
    wanted, error = F.col("train_rows") * prep.SPEND_CAP_QUANTILE, F.col("train_rows") / prep.SKETCH_ACCURACY + 1
    return counted.select("train_rows", ((F.col("below") <= wanted + error) & (F.col("up_to") >= wanted - error)).alias("within_bound"))


def _feature_assembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sliced(spark, sf)
    fitted = prep.feature_assembly(LOOKBACK).fit(rows.filter("slice <> 'test'"))
    return fitted.transform(rows).select(
        "user_id", "as_of_date", "slice", models.vector_to_array("features").alias("features")
    )


def _test_slice(spark: SparkSession, sf: str, part: str = "test") -> DataFrame:
    """One slice; a snapshot's rows do not depend on earlier snapshots, so only those up to the slice are made."""
    return _scored(spark, sf, {"test": 1, "validation": 2}[part]).filter(F.col("slice") == part)


def _policies(spark: SparkSession, sf: str, part: str = "test") -> DataFrame:
    return policy.policy_comparison(_test_slice(spark, sf, part), BUDGET, COST, HORIZON)


def _predictions_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    return writers.predictions_csv_sink(_test_slice(spark, sf), scratch_path(spark, "predictions"), HORIZON)


def _policy_cycles(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut_lineage(_scored(spark, sf, 2))
    parts = {"initial": "validation", "retrain": "test"}
    return policy.policy_cycle_comparison(
        {cycle: policy.policy_comparison(scored.filter(F.col("slice") == part), BUDGET, COST, HORIZON) for cycle, part in parts.items()}
    )


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.inter_purchase_gaps(_silver(spark, sf))


def _recency_scorer(fit: DataFrame, score: DataFrame, lookback: int) -> DataFrame:
    return score.withColumn("propensity_score", F.lit(1.0) / (F.lit(1.0) + F.col("recency_days") / F.lit(30.0)))


def _frequency_scorer(fit: DataFrame, score: DataFrame, lookback: int) -> DataFrame:
    frequency = F.col(f"frequency_{lookback}d")
    return score.withColumn("propensity_score", frequency / (F.lit(1.0) + frequency))


def _freeze_decision(spark: SparkSession, sf: str) -> DataFrame:
    scorers = {"logistic_regression": _recency_scorer, "boosted_trees": _frequency_scorer}
    return sensitivity.freeze_decision(sensitivity.window_sweep(stored(_panel(spark, sf)), scorers))


def propensity_queries() -> dict[str, Query]:
    label = f"label_purchase_{HORIZON}d"
    return {
        "training_rows": _rows,
        "split_10_1_1": lambda s, sf: _sliced(s, sf).select("user_id", "as_of_date", "slice"),
        "label_class_check": lambda s, sf: prep.label_class_check(_sliced(s, sf).filter("slice = 'train'")),
        "spend_cap_value": lambda s, sf: rounded(
            prep.spend_cap_value(_sliced(s, sf).filter("slice = 'train'"), LOOKBACK)
        ),
        "spend_cap_sketch": _spend_cap_sketch,
        "apply_spend_cap": _apply_spend_cap,
        "country_one_hot": _country_one_hot,
        "country_vectors": _country_vectors,
        "feature_assembly": _feature_assembly,
        "revenue_fallback_mean": lambda s, sf: rounded(
            models.revenue_fallback_mean(_sliced(s, sf).filter("slice = 'train'"))
        ),
        "roc_auc": _metric(metrics.roc_auc),
        "average_precision": _metric(metrics.average_precision),
        "top_decile_lift": _metric(metrics.top_decile_lift),
        "brier_score": _metric(metrics.brier_score),
        "ece_10_bin": _metric(metrics.ece_10_bin),
        "revenue_errors": lambda s, sf: metrics.revenue_errors(
            _scored(s, sf), f"label_net_revenue_{HORIZON}d", REVENUE, label
        ),
        "expected_value_score": lambda s, sf: rounded(
            _scored(s, sf).select("user_id", "as_of_date", "expected_value_score")
        ),
        "random_policy_score": lambda s, sf: rounded(
            _scored(s, sf).select("user_id", "as_of_date", "random_policy_score")
        ),
        "rfm_policy_score": lambda s, sf: rounded(_scored(s, sf).select("user_id", "as_of_date", "rfm_policy_score")),
        "budget_top_k": lambda s, sf: rounded(
            policy.budget_top_k(_test_slice(s, sf), "rfm_policy_score", BUDGET, COST).select(
                "user_id", "as_of_date", "rfm_policy_score"
            )
        ),
        "policy_comparison": _policies,
        "policy_deltas": lambda s, sf: policy.policy_deltas(_policies(s, sf)),
        "policy_cycle_comparison": _policy_cycles,
        "predictions_csv_sink": _predictions_csv_sink,
        "inter_purchase_gaps": lambda s, sf: plain(_gaps(s, sf)),
        "gap_distribution": lambda s, sf: sensitivity.gap_distribution(_gaps(s, sf)),
        "gap_coverage": lambda s, sf: sensitivity.gap_coverage(_gaps(s, sf)),
        "freeze_decision": _freeze_decision,
    }


# --- propensity: trained models (rows-only checks) ----------------------------------------------------------------
def _fit_and_score(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, float]:
    rows, cap = _capped(spark, sf)
    return rows.filter("slice = 'train'"), rows.filter("slice = 'validation'"), cap


def _base_model(name: str, rounds: int | None = None) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        fit, score, _ = _fit_and_score(spark, sf)
        fitted = models.fit_base_model(name, fit, LOOKBACK, rounds)
        out = fitted.transform(score)
        return out.select("user_id", "as_of_date", models.vector_to_array("probability")[1].alias("probability"))

    return query


def _calibrated(spark: SparkSession, sf: str) -> DataFrame:
    fit, score, _ = _fit_and_score(spark, sf)
    return models.calibrated_scores(fit, score, "boosted_trees", LOOKBACK).select(
        "user_id", "as_of_date", "propensity_score"
    )


def _stage(function) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows, _ = _capped(spark, sf)
        return function(rows, "logistic_regression", LOOKBACK).select("user_id", "as_of_date", "propensity_score")

    return query


def _conditional_revenue(spark: SparkSession, sf: str) -> DataFrame:
    fit, score, _ = _fit_and_score(spark, sf)
    return models.conditional_revenue(fit, score, LOOKBACK).select(
        "user_id", "as_of_date", "predicted_conditional_revenue"
    )


def _batch_score_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    clean = cut_lineage(_silver(spark, sf))
    panel = labels.propensity_panel(clean, PANEL_END, check_bounds=False)
    rows = prep.split_10_1_1(cut_lineage(prep.training_rows(panel, HORIZON, LOOKBACK)))
    fit = rows.filter("slice <> 'test'")
    cap = prep.spend_cap_value(rows.filter("slice = 'train'"), LOOKBACK).first()[0]
    fit = prep.apply_spend_cap(fit, LOOKBACK, cap)
    folder = scratch_path(spark, "model")
    chance, spend = models.side_by_side(
        spark,
        lambda: models.fit_calibrated(fit, "logistic_regression", LOOKBACK),
        lambda: models.fit_conditional_revenue(fit, LOOKBACK),
    )
    chance.save(f"{folder}/propensity")
    spend.save(f"{folder}/revenue")
    propensity = models.CalibratedPropensity.load(spark, f"{folder}/propensity")
    revenue = models.ConditionalRevenue.load(spark, f"{folder}/revenue")
    snapshot = features.user_features_asof(clean, [PANEL[-1]])
    return rounded(models.batch_score_snapshot(snapshot, propensity, revenue, cap, HORIZON))


def _train_metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut_lineage(_scored(spark, sf))
    return metrics.train_metrics_table(
        scored.filter("slice = 'validation'"),
        scored.filter("slice = 'test'"),
        scored.filter("slice = 'train'"),
        {"prediction_window_days": HORIZON, "feature_lookback_days": LOOKBACK},
        label=f"label_purchase_{HORIZON}d",
        actual=f"label_net_revenue_{HORIZON}d",
        predicted=REVENUE,
    )


def _window_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.window_sweep(stored(_panel(spark, sf)), sensitivity.trained_scorers())


def model_queries() -> dict[str, Query]:
    return {
        "propensity_logistic": _base_model("logistic_regression"),
        "propensity_gbt": _base_model("boosted_trees"),
        "calibrated_scores": _calibrated,
        "fit_validation_stage": _stage(models.fit_validation_stage),
        "fit_test_stage": _stage(models.fit_test_stage),
        "conditional_revenue": _conditional_revenue,
        "batch_score_snapshot": _batch_score_snapshot,
        "train_metrics_table": _train_metrics_table,
        "window_sweep": _window_sweep,
    }


# --- recommender --------------------------------------------------------------------------------------------------
# Vector width of the factor models.
COMPONENTS = 64


def _gold(spark: SparkSession, sf: str) -> recommender.RecommenderGold:
    """Split rows, indices and train pairs without the gates, which have queries of their own."""
    rows = cut_lineage(_splits(spark, sf))
    users, items = splits.user_index(rows), splits.item_index(rows)
    pairs = cut_lineage(retrieval.positive_pairs(rows, users, items))
    return recommender.RecommenderGold(rows, users, items, pairs, users.count(), items.count())


def _popularity(gold: recommender.RecommenderGold, **options) -> DataFrame:
    return retrieval.popularity_scores(gold.split_rows, gold.item_index, **options)


def _popular_lists(gold: recommender.RecommenderGold, **options) -> DataFrame:
    return retrieval.popularity_top_k(_popularity(gold, **options), gold.user_index, gold.pairs, EVALUATION_K)


def _popular_metrics(gold: recommender.RecommenderGold) -> DataFrame:
    """Two exact rankings: popularity by rows, and by distinct users."""
    lists = {"popularity": _popular_lists(gold), "popularity_users": _popular_lists(gold, distinct_users=True)}
    # Frozen: each list meets both slices, each slice both lists.
    lists, truth = ({name: cut_lineage(df) for name, df in found.items()} for found in (lists, recommender.held_out(gold)))
    return ranking.model_metrics(lists, truth, gold.pairs, gold.n_items)


def _on_gold(function) -> Query:
    return lambda spark, sf: function(_gold(spark, sf))


def _tfidf(gold: recommender.RecommenderGold) -> DataFrame:
    return retrieval.tfidf_interactions(gold.pairs, gold.n_users)


def _validation_truth(gold: recommender.RecommenderGold) -> DataFrame:
    return recommender.held_out(gold)["validation"]


def _per_user(metric) -> Query:
    return _on_gold(lambda gold: rounded(metric(_popular_lists(gold), _validation_truth(gold))))


def _vectors(spark: SparkSession, sf: str, key: str) -> DataFrame:
    table = readers.table(spark, sf, "embeddings")
    return table.select(F.col("vec_id").alias(key), F.col("embedding").cast("array<double>").alias("vector"))


def _l2_normalize_rows(spark: SparkSession, sf: str) -> DataFrame:
    unit = retrieval.l2_normalize_rows(_vectors(spark, sf, "vec_id"))
    return rounded(unit.select("vec_id", F.posexplode("vector").alias("pos", "value")))


def _dot_product_scores(spark: SparkSession, sf: str) -> DataFrame:
    users, items = _vectors(spark, sf, "user_idx"), _vectors(spark, sf, "item_idx")
    pairs = users.select("user_idx", (F.col("user_idx") + 1).alias("item_idx"))
    return rounded(retrieval.dot_product_scores(users, items, pairs))


def _embedding_search(search) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        users, items = _vectors(spark, sf, "user_idx"), _vectors(spark, sf, "item_idx")
        itself = users.select("user_idx", F.col("user_idx").alias("item_idx"))
        return rounded(search(users, items, itself, 10))

    return query


def _mf_factors(gold: recommender.RecommenderGold) -> DataFrame:
    users, items = retrieval.mf_factors(_tfidf(gold), gold.n_users, gold.n_items, COMPONENTS)
    return users.select(F.lit("user").alias("side"), F.col("user_idx").alias("idx"), "vector").unionByName(
        items.select(F.lit("item").alias("side"), F.col("item_idx").alias("idx"), "vector")
    )


def _learned_retriever(gold: recommender.RecommenderGold) -> DataFrame:
    users, items = embeddings.learned_retriever(gold.pairs, COMPONENTS)
    return users.select(F.lit("user").alias("side"), F.col("user_idx").alias("idx"), "vector").unionByName(
        items.select(F.lit("item").alias("side"), F.col("item_idx").alias("idx"), "vector")
    )


def _item_embedding_table(gold: recommender.RecommenderGold) -> DataFrame:
    _, items = retrieval.mf_factors(_tfidf(gold), gold.n_users, gold.n_items, COMPONENTS)
    return retrieval.item_embedding_table(items, gold.item_index, "mf")


def _topk_recommendations(gold: recommender.RecommenderGold) -> DataFrame:
    users, items = retrieval.mf_factors(_tfidf(gold), gold.n_users, gold.n_items, COMPONENTS)
    everyone = retrieval.with_zero_vectors(gold.user_index, users, COMPONENTS)
    ranked = retrieval.embedding_top_k(everyone, items, gold.pairs, EVALUATION_K)
    return retrieval.topk_recommendations("mf", ranked, gold.user_index, gold.item_index)


def _rank_candidates(gold: recommender.RecommenderGold) -> DataFrame:
    """Ranks all unseen items by the number of distinct buyers; the lists hold each user's best of the whole pool."""
    listed = _popular_lists(gold, distinct_users=True).select("user_idx", "item_idx", "score")
    return rounded(ranking.rank_candidates(listed).select("user_idx", "item_idx", "rank", "score"))


def _retriever_sweep(gold: recommender.RecommenderGold) -> DataFrame:
    base = {"rank": COMPONENTS, "epochs": 2}
    return ranking.retriever_sweep(gold.pairs, recommender.held_out(gold), gold.user_index, gold.n_items, base)


def recommender_queries() -> dict[str, Query]:
    return {
        "split_interactions": _on_gold(lambda g: retrieval.split_interactions(g.split_rows)),
        "positive_pairs": _on_gold(lambda g: g.pairs),
        "sampled_negatives": _on_gold(lambda g: retrieval.sampled_negatives(g.pairs, 8, g.n_items)),
        "popularity_scores": _on_gold(lambda g: rounded(_popularity(g))),
        "tfidf_interactions": _on_gold(lambda g: rounded(_tfidf(g))),
        "mf_factors": _on_gold(_mf_factors),
        "learned_retriever": _on_gold(_learned_retriever),
        "l2_normalize_rows": _l2_normalize_rows,
        "candidate_items": _on_gold(lambda g: retrieval.candidate_items(g.user_index, g.item_index, g.pairs)),
        "dot_product_scores": _dot_product_scores,
        "popularity_top_k": _on_gold(lambda g: rounded(_popular_lists(g))),
        "embedding_top_k": _embedding_search(retrieval.embedding_top_k),
        "approx_top_k": _embedding_search(retrieval.approx_top_k),
        "item_embedding_table": _on_gold(_item_embedding_table),
        "topk_recommendations": _on_gold(_topk_recommendations),
        "held_out_truth": _on_gold(_validation_truth),
        "eligible_users": _on_gold(lambda g: ranking.eligible_users(_validation_truth(g), g.pairs, g.n_items)),
        "rank_candidates": _on_gold(_rank_candidates),
        "recall_at_k": _per_user(ranking.recall_at_k),
        "hit_rate_at_k": _per_user(ranking.hit_rate_at_k),
        "ndcg_at_k": _per_user(ranking.ndcg_at_k),
        "model_metrics": _on_gold(_popular_metrics),
        "select_best_model": _on_gold(lambda g: ranking.select_best_model(_popular_metrics(g))),
        "recall_comparison": _on_gold(lambda g: ranking.recall_comparison(_popular_metrics(g))),
        "random_recall_anchor": _on_gold(
            lambda g: ranking.random_recall_anchor(_popular_metrics(g), EVALUATION_K, g.n_items)
        ),
        "retriever_sweep": _on_gold(_retriever_sweep),
    }


# --- whole runs and their gates -----------------------------------------------------------------------------------
def _propensity_run(spark: SparkSession, sf: str) -> propensity.PropensityRun:
    return propensity.propensity_pipeline(
        cut_lineage(_silver(spark, sf)),
        PANEL_END,
        mode="fixed",
        model="logistic_regression",
        horizon=HORIZON,
        lookback=LOOKBACK,
        budget=BUDGET,
        cost=COST,
    )


def _recommender_run(spark: SparkSession, sf: str, **options) -> recommender.RecommenderRun:
    clean = cut_lineage(_silver(spark, sf))
    return recommender.recommender_pipeline(
        clean, INTERACTIONS_FROM, INTERACTIONS_TO, EVALUATION_K, COMPONENTS, COMPONENTS, **options
    )


def _stand_in_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics and the policies of validation and test, by the stand-in scores."""
    scored = cut_lineage(_scored(spark, sf))
    parts = [scored.filter(F.col("slice") == part) for part in ("validation", "test")]
    table = metrics.train_metrics_table(
        *parts, label=f"label_purchase_{HORIZON}d", actual=f"label_net_revenue_{HORIZON}d", predicted=REVENUE
    )
    return table, *(policy.policy_comparison(part, BUDGET, COST, HORIZON) for part in parts)


def _stand_in_checks(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_propensity_outputs("logistic_regression", *_stand_in_results(spark, sf))


def _interpretation_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """The headline numbers of both reports, each written once: the propensity one by stand-in scores, so that it is exact."""
    gold = _gold(spark, sf)
    anchored = ranking.random_recall_anchor(cut_lineage(_popular_metrics(gold)), EVALUATION_K, gold.n_items)
    results = [cut_lineage(df) for df in _stand_in_results(spark, sf)]
    return validate.interpretation_kpis(validate.propensity_kpis(*results), validate.recommender_kpis(anchored))


def _serving_scores_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Serving scores of the test slice as written: stand-in scores, so that the result is exact."""
    path = scratch_path(spark, "serving")
    writers.serving_scores_csv_sink(_test_slice(spark, sf), path, HORIZON)
    doubles = ", ".join(f"{name} double" for name in ("propensity_score", REVENUE, "expected_value_score"))
    return spark.read.schema(f"user_id string, as_of_date string, {doubles}").options(header=True, escape='"').csv(path)


def _sensitivity_run(spark: SparkSession, sf: str) -> DataFrame:
    """The sweep of both models, the frozen choice, the chosen model trained and compared: its gates, sweep rule included."""
    return propensity.propensity_pipeline(
        cut_lineage(_silver(spark, sf)), PANEL_END, mode="sensitivity", budget=BUDGET, cost=COST
    ).checks


def pipeline_queries() -> dict[str, Query]:
    return {
        "serving_scores_csv_sink": _serving_scores_csv_sink,
        "propensity_sensitivity_run": _sensitivity_run,
        "validate_propensity_outputs": _stand_in_checks,
        "validate_recommender_outputs": lambda s, sf: _recommender_run(s, sf).checks,
        "propensity_pipeline": lambda s, sf: writers.predictions_table(_propensity_run(s, sf).scored_test, HORIZON),
        "recommender_pipeline": lambda s, sf: _recommender_run(s, sf).topk,
        "recommender_pipeline_approximate": lambda s, sf: _recommender_run(s, sf, approximate=True).topk,
        "recommender_run_metrics": lambda s, sf: _recommender_run(s, sf).metrics,
        "recommender_run_selected": lambda s, sf: _recommender_run(s, sf).selected,
        "recommender_run_kpis": lambda s, sf: _recommender_run(s, sf).kpis,
        "propensity_run_kpis": lambda s, sf: _propensity_run(s, sf).kpis,
        "interpretation_kpis": _interpretation_kpis,
    }


def all_queries() -> dict[str, Query]:
    return {
        **gold_queries(),
        **dq_queries(),
        **propensity_queries(),
        **model_queries(),
        **recommender_queries(),
        **pipeline_queries(),
    }
