"""Offline ranking evaluation and model selection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.functions.columns import round_half_away
from bazaarflow.functions.scale import shuffled
from bazaarflow.operators.embeddings import learned_retriever
from bazaarflow.operators.retrieval import embedding_top_k, with_zero_vectors
from bazaarflow.schemas import EVALUATION_K, RETRIEVERS

HELD_OUT = {"validation": "val", "test": "test"}


def held_out_truth(splits: DataFrame, split: str, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """Held-out items of each user that exist among the train items; repeat purchases stay in."""
    rows = splits.filter(F.col("split") == split).select("user_id", "item_id").distinct()
    return rows.join(shuffled(item_index), "item_id").join(shuffled(user_index), "user_id").select("user_idx", "item_idx")


def eligible_users(truth: DataFrame, pairs: DataFrame, n_items: int) -> DataFrame:
    """Users with train items, with something to find, and with at least one unseen item left."""
    trained = pairs.groupBy("user_idx").agg(F.count(F.lit(1)).alias("seen_items")).filter(F.col("seen_items") < n_items)
    return trained.select("user_idx").join(shuffled(truth), "user_idx", "left_semi")


def rank_candidates(scores: DataFrame, k: int = EVALUATION_K) -> DataFrame:
    """The ``k`` best-scored candidates per user, equal scores in item order. Cut to ``k`` per task before the shuffle."""
    order = Window.partitionBy("user_idx").orderBy(F.desc("score"), F.asc("item_idx"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def user_metrics(ranked: DataFrame, truth: DataFrame, k: int = EVALUATION_K) -> DataFrame:
    """Recall, hit rate and NDCG of each ranked user that has held-out items."""
    listed = ranked.filter(F.col("rank") <= k).select("user_idx", "item_idx", "rank")
    found = listed.join(shuffled(truth.withColumn("hit", F.lit(1))), ["user_idx", "item_idx"], "left")
    per_user = found.groupBy("user_idx").agg(
        F.count("hit").alias("hits"),
        F.count(F.lit(1)).alias("depth"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    wanted = truth.groupBy("user_idx").agg(F.count(F.lit(1)).alias("relevant"))
    ideal, running = [], 0.0
    for rank in range(1, k + 1):
        running += 1 / math.log2(rank + 1)
        ideal.append(F.lit(running))
    best = F.element_at(F.array(*ideal), F.least("relevant", "depth").cast("int"))
    return per_user.join(shuffled(wanted), "user_idx").select(
        "user_idx",
        (F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        (F.col("dcg") / best).alias("ndcg"),
    )


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int = EVALUATION_K) -> DataFrame:
    return user_metrics(ranked, truth, k).select("user_idx", "recall")


def hit_rate_at_k(ranked: DataFrame, truth: DataFrame, k: int = EVALUATION_K) -> DataFrame:
    return user_metrics(ranked, truth, k).select("user_idx", "hit_rate")


def ndcg_at_k(ranked: DataFrame, truth: DataFrame, k: int = EVALUATION_K) -> DataFrame:
    return user_metrics(ranked, truth, k).select("user_idx", "ndcg")


def _mean_metrics(per_user: DataFrame, model: str, split: str) -> DataFrame:
    def mean(name: str):
        return round_half_away(F.coalesce(F.avg(name), F.lit(0.0)), 6)

    row = per_user.agg(
        F.count(F.lit(1)).alias("eligible_users"),
        mean("recall").alias("recall_at_20"),
        mean("ndcg").alias("ndcg_at_20"),
        mean("hit_rate").alias("hit_rate_at_20"),
    )
    return row.select(F.lit(model).alias("model_name"), F.lit(split).alias("split"), *row.columns)


def model_metrics(
    ranked: Mapping[str, DataFrame], truth: Mapping[str, DataFrame], pairs: DataFrame, n_items: int
) -> DataFrame:
    """Mean metrics per model and slice over the eligible users; zeros when there are none.

    ``ranked`` maps a model to its unseen top-20 lists, ``truth`` maps ``validation`` / ``test`` to the held-out items.
    """
    out = None
    for model, lists in ranked.items():
        for split, items in truth.items():
            users = eligible_users(items, pairs, n_items)
            part = _mean_metrics(user_metrics(lists.join(shuffled(users), "user_idx", "left_semi"), items), model, split)
            out = part if out is None else out.unionByName(part)
    return out


def select_best_model(metrics: DataFrame) -> DataFrame:
    """Highest validation recall; on a tie the earlier model of the fixed order wins."""
    order = F.create_map(*(F.lit(x) for i, name in enumerate(RETRIEVERS) for x in (name, i)))
    return (
        metrics.filter(F.col("split") == "validation")
        .withColumn("model_order", F.try_element_at(order, F.col("model_name")))
        .orderBy(F.desc("recall_at_20"), F.asc_nulls_last("model_order"))
        .limit(1)
        .select(F.col("model_name").alias("selected_model_name"), "recall_at_20")
    )


def recall_comparison(metrics: DataFrame) -> DataFrame:
    """Recall by model, one column per slice."""
    return metrics.groupBy("model_name").agg(
        *(F.max(F.when(F.col("split") == s, F.col("recall_at_20"))).alias(f"{s}_recall_at_20") for s in HELD_OUT)
    )


def random_recall_anchor(metrics: DataFrame, k: int, n_items: int) -> DataFrame:
    """Recall of random lists (k over the item count) and each model's lift over it; NULL lift without items."""
    anchor = k / n_items if n_items > 0 else 0.0
    lift = F.try_divide(F.col("recall_at_20"), F.lit(anchor))
    return metrics.select(
        "model_name",
        "split",
        "recall_at_20",
        round_half_away(F.lit(anchor), 6).alias("random_recall_anchor"),
        round_half_away(lift, 6).alias("lift"),
    )


# Base settings of the learned retriever and the eight variations tried on top of it.
SWEEP_OVERRIDES = (
    {},
    {"temperature": 0.05},
    {"temperature": 0.2},
    {"rate": 0.1},
    {"rate": 0.6},
    {"negatives": 4},
    {"negatives": 16},
    {"temperature": 0.05, "rate": 0.1},
    {"temperature": 0.2, "negatives": 16},
)


def retriever_sweep(
    pairs: DataFrame,
    truth: Mapping[str, DataFrame],
    user_index: DataFrame,
    n_items: int,
    base: Mapping[str, float],
    overrides: Sequence[Mapping[str, float]] = SWEEP_OVERRIDES,
) -> DataFrame:
    """Recall of the learned retriever for each setting, the best validation trial marked. Trials run one by one."""
    rows = []
    for i, changes in enumerate(overrides):
        settings = {**base, **changes}
        users, items = learned_retriever(pairs, **settings)
        everyone = with_zero_vectors(user_index, users, int(settings.get("rank", 64)))
        ranked = embedding_top_k(everyone, items, pairs, EVALUATION_K)
        values = {r["split"]: r["recall_at_20"] for r in model_metrics({"learned": ranked}, truth, pairs, n_items).collect()}
        name = "trial_default" if i == 0 else f"trial_{i}"
        rows.append((i, name, str(dict(sorted(settings.items()))), values.get("validation", 0.0), values.get("test", 0.0)))
    best = max(rows, key=lambda r: (r[3], -r[0]))[1] if rows else None
    table = pairs.sparkSession.createDataFrame(
        rows, "trial int, trial_name string, settings string, validation_recall_at_20 double, test_recall_at_20 double"
    )
    return table.withColumn("is_best", F.col("trial_name") == F.lit(best))
