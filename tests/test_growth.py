"""Steps whose cost has to follow the size of the input: no copies of growing tables, no work done twice."""

from __future__ import annotations

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from bazaarflow.functions.columns import l2_normalized
from bazaarflow.functions.scale import one_block_a_task, spread_by
from bazaarflow.operators import ranking, retrieval
from bazaarflow.sources import readers, writers


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_growing_indices_are_not_broadcast(spark):
    rows = spark.createDataFrame([("u1", "i1", "train"), ("u1", "i2", "val")], "user_id string, item_id string, split string")
    users = spark.createDataFrame([("u1", 0)], "user_id string, user_idx bigint")
    items = spark.createDataFrame([("i1", 0), ("i2", 1)], "item_id string, item_idx bigint")
    pairs = retrieval.positive_pairs(rows, users, items)
    truth = ranking.held_out_truth(rows, "val", users, items)
    assert [tuple(r) for r in pairs.collect()] == [(0, 0)]
    assert [tuple(r) for r in truth.collect()] == [(0, 1)]
    for df in (pairs, truth, ranking.eligible_users(truth, pairs, 2)):
        assert "BroadcastHashJoin" not in plan_of(df)


def test_parts_and_customers_are_not_broadcast(spark, tmp_path):
    for name, schema in readers.TABLE_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    joins = plan_of(readers.retail_lines(spark, str(tmp_path)))
    assert joins.split("===")[0].count("SortMergeJoin") >= 3


def test_vector_length_is_worked_out_once_a_row(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0],)], "vector array<double>")
    assert df.select(l2_normalized(F.col("vector"))).first()[0] == [0.6, 0.8, 0.0, 0.0]
    assert df.select(l2_normalized(F.lit(None).cast("array<double>"))).first()[0] is None
    text = plan_of(df.select(l2_normalized(F.col("vector")).alias("unit")))
    assert "array_repeat" in text


def test_short_rows_are_spread_over_all_tasks(spark):
    few = spread_by(spark.range(64).withColumn("block", F.col("id").cast("int")), "block")
    used = few.groupBy("block").count().select(F.spark_partition_id()).distinct().count()
    assert used > 8


def test_every_block_has_a_task_of_its_own_on_both_sides(spark):
    left = one_block_a_task(spark.range(600).select((F.col("id") % 12).cast("int").alias("block")), "block", 12)
    right = one_block_a_task(spark.range(600).select((F.col("id") % 12).cast("int").alias("asking")), "asking", 12)

    def one(key, own, sent):
        return own.head(1)

    met = left.groupBy("block").cogroup(right.groupBy("asking")).applyInPandas(one, "block int")
    placed = met.select("block", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["block"] for r in placed) == list(range(12)) and len({r["task"] for r in placed}) == 12


def test_tiles_give_the_same_lists_as_a_full_sort(monkeypatch):
    rng = np.random.default_rng(1)
    users, items = rng.integers(-2, 3, (7, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float)
    user_ids, item_ids = np.arange(7) + 100, np.sort(rng.choice(1000, 50, replace=False))
    hidden = [None if i % 3 == 0 else rng.choice(item_ids, 5).tolist() + [5000] for i in range(7)]
    for tile in (256, 256 * 7, 1 << 20):
        monkeypatch.setattr(retrieval, "SCORES_IN_MEMORY", tile)
        got = retrieval._rank_block(user_ids, users, hidden, item_ids, items, 6)
        for row, user in enumerate(user_ids):
            scores = users[row] @ items.T
            open_ = [(-s, i) for s, i in zip(scores, item_ids, strict=True) if hidden[row] is None or i not in hidden[row]]
            wanted = [(i, -s) for s, i in sorted(open_)[:6]]
            own = got[got["user_idx"] == user]
            assert list(zip(own["item_idx"], own["score"], strict=True)) == wanted


def test_exported_files_have_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ROWS_PER_FILE", 10)
    spark.range(95).coalesce(1).write.parquet(f"{tmp_path}/in")
    writers.parquet_to_csv_export(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("*.csv"))) == 10
    assert spark.read.options(header=True, multiLine=True).csv(f"{tmp_path}/out").count() == 95


def test_written_predictions_are_not_worked_out_again(spark, tmp_path):
    names = writers.prediction_columns(30)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([("u", "2000-01-01", *([1.0] * 7))], ", ".join([f"{n} string" for n in names[:2]] + [f"{n} double" for n in names[2:]]))
    out = writers.predictions_csv_sink(rows.withColumn("propensity_score", counted("propensity_score")), f"{tmp_path}/csv", 30)
    assert out.count() == 1 and out.collect()[0]["propensity_score"] == 1.0
    assert read.value == 1


def test_scores_that_single_floats_cannot_tell_apart_are_ranked_exactly():
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    items = base + 1e-10 * rng.standard_normal((60, 8))
    items[50:55] = items[7]
    users = np.vstack([base, 1e-30 * base, 1e30 * base, np.zeros(8), -base])
    hidden = [None, [7], None, [0, 3], None]
    exact = np.einsum("ud,id->uid", users, items).sum(axis=2)
    worst = np.array([np.nan, np.nan, np.sort(exact[2])[-3], np.nan, np.sort(exact[4])[-4]])
    got = retrieval._rank_block(np.arange(5), users, hidden, np.arange(60), items, 6, worst)
    for user in range(5):
        rows = got[got["user_idx"] == user]
        scores = np.einsum("nd,nd->n", np.repeat(users[user : user + 1], 60, axis=0), items)
        order = [i for i in np.lexsort((np.arange(60), -scores)) if i not in (hidden[user] or [])]
        order = [i for i in order if not scores[i] < worst[user]][:6]
        assert list(rows["item_idx"]) == order and list(rows["score"]) == list(scores[order])


def test_vectors_too_long_to_be_scaled_are_still_ranked():
    users, items = np.array([[1e200, 0.0], [1.0, 2.0]]), np.array([[1.0, 1.0], [2.0, 0.5], [0.0, np.nan], [3.0, -1.0]])
    got = retrieval._rank_block(np.arange(2), users, [None, None], np.arange(4), items, 2)
    assert [tuple(r)[:2] for r in got.itertuples(index=False)] == [(0, 3), (0, 1), (1, 0), (1, 1)]


def test_later_blocks_hand_back_only_rows_that_may_enter_a_list(spark):
    users = spark.createDataFrame([(0, [1.0, 0.0], 2.0, 1), (1, [1.0, 0.0], None, 1)], "user_idx bigint, vector array<double>, worst double, item_block int")
    items = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(4)], "item_idx bigint, vector array<double>, item_block int")
    seen = spark.createDataFrame([(1, 3)], "user_idx bigint, item_idx bigint")
    rows = retrieval._scored_blocks(users, items, seen, 10, 2).collect()
    assert sorted(map(tuple, rows)) == [(0, 2, 2.0), (0, 3, 3.0), (1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0)]
