"""Recommender gold tables: interactions, chronological split, entity indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.functions.columns import has_user
from bazaarflow.functions.scale import rank_within, shuffled, with_ordinal

MOMENT = ("user_id", "invoice_id", "event_ts")


def interaction_events(silver: DataFrame, min_date: str, max_date: str) -> DataFrame:
    """Purchases of known users between two dates, both included. Times become ISO text, the weight is the quantity."""
    low, high = F.lit(str(min_date)).cast("date"), F.lit(str(max_date)).cast("date")
    return silver.filter(has_user() & (F.col("quantity") > 0) & F.col("event_date").between(low, high)).select(
        "user_id",
        "item_id",
        "invoice_id",
        F.col("event_ts").cast("string").alias("event_ts"),
        F.col("event_date").cast("string").alias("event_date"),
        F.col("quantity").alias("weight"),
    )


def invoice_moments(interactions: DataFrame) -> DataFrame:
    """Distinct purchase occasions."""
    return interactions.select(*MOMENT).distinct()


def invoice_recency_rank(moments: DataFrame) -> DataFrame:
    """1 for a user's latest occasion, counting backwards; equal times are ordered by invoice id, descending."""
    return rank_within(moments, "user_id", [F.desc("event_ts"), F.desc("invoice_id")], "recency_rank")


def user_item_splits(interactions: DataFrame) -> DataFrame:
    """Latest occasion of a user to test, the one before to val, the rest to train.

    Only the two newest occasions matter, so the ranking is limited to two rows per user and task before the shuffle;
    a user with very many occasions never lands in one task.
    """
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("event_ts"), F.desc("invoice_id"))
    held_out = (
        invoice_moments(interactions)
        .withColumn("recency_rank", F.row_number().over(newest_first))
        .filter(F.col("recency_rank") <= 2)
    )
    split = F.when(F.col("recency_rank") == 1, "test").when(F.col("recency_rank") == 2, "val").otherwise("train")
    return interactions.join(shuffled(held_out), list(MOMENT), "left").select(
        "user_id", "item_id", "invoice_id", "event_ts", "event_date", split.alias("split")
    )


def _entity_index(ids: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    indexed, _ = with_ordinal(ids.select(id_col).distinct(), [id_col], idx_col)
    return indexed


def user_index(splits: DataFrame) -> DataFrame:
    """0-based position of every split user in id order."""
    return _entity_index(splits, "user_id", "user_idx")


def item_index(splits: DataFrame) -> DataFrame:
    """0-based position of every item of the train split in id order."""
    return _entity_index(splits.filter(F.col("split") == "train"), "item_id", "item_idx")
