"""Tables that every block needs are read where they lie: what is shuffled does not grow with blocks times rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaarflow.functions.scale import beside_each, cut_lineage, own_and_table, stored, tasks_kept_apart
from bazaarflow.functions.vectors import as_arrays, as_bytes
from bazaarflow.operators import embeddings, retrieval
from bazaarflow.sources import writers

PAIRS = "user_idx bigint, item_idx bigint"


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_every_block_meets_the_whole_table_without_a_shuffle(spark):
    own = stored(spark.range(60).select((F.col("id") % 3).cast("int").alias("block"), "id"), "block")
    table = stored(spark.range(1000).select(F.col("id").alias("idx")).repartition(7))
    rows_of = dict(own.groupBy("block").count().collect())

    def met(batches):
        block, mine, rest = own_and_table(batches, "block", rows_of)
        seen = sum(sum(batch.column("idx").to_pylist()) for batch in rest)
        yield pa.RecordBatch.from_pydict({"block": [block], "own": [sum(mine["id"].to_pylist())], "seen": [seen]})

    with tasks_kept_apart(spark):
        df = beside_each(own, table, "block", [0, 1, 2]).mapInArrow(met, "block bigint, own bigint, seen bigint")
        assert not exchanges(df)
        assert sorted(map(tuple, df.collect())) == [(b, sum(range(b, 60, 3)), sum(range(1000))) for b in range(3)]


def test_rows_of_the_table_that_come_first_are_kept():
    batches = [
        pa.RecordBatch.from_pydict({"block": pa.array([None, None], pa.int32()), "idx": [1, 2]}),
        pa.RecordBatch.from_pydict({"block": pa.array([4, None], pa.int32()), "idx": [None, 3]}),
        pa.RecordBatch.from_pydict({"block": pa.array([4, None], pa.int32()), "idx": [None, 4]}),
        pa.RecordBatch.from_pydict({"block": pa.array([None], pa.int32()), "idx": [5]}),
    ]
    block, own, rest = own_and_table(iter(batches), "block", {4: 2})
    assert (block, own.num_rows) == (4, 2)
    assert [i for batch in rest for i in batch.column("idx").to_pylist()] == [1, 2, 3, 4, 5]


def test_vectors_come_back_from_bytes(spark):
    rows = [(i, [float(i), -0.5, 1e300]) for i in range(25)]
    df = spark.createDataFrame(rows, "idx bigint, vector array<double>").repartition(3)
    back = as_arrays(as_bytes(df, "idx bigint"), "idx bigint", 3)
    assert sorted((r.idx, r.vector) for r in back.collect()) == rows


@pytest.mark.parametrize("most_pairs", [1_000_000, 10])
def test_factors_of_many_pairs_are_those_of_few(spark, monkeypatch, most_pairs):
    """With ten pairs to a block most users and items are dealt to several."""
    rng = np.random.default_rng(5)
    dense = rng.random((40, 3)) @ rng.random((3, 30)) + 0.3 * rng.random((40, 30)) > 1.1
    pairs = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*dense.nonzero())], PAIRS)
    weighted = retrieval.tfidf_interactions(pairs, 40)
    init = retrieval._StoredPairs.__init__
    monkeypatch.setattr(retrieval._StoredPairs, "__init__", lambda self, rows: init(self, rows, 9, most_pairs))

    def scores(most):
        monkeypatch.setattr(retrieval, "MOST_MOVED_PAIRS", most)
        sides = retrieval.mf_factors(weighted, 40, 30, components=4)
        u, v = ({r[0]: r[1] for r in side.collect()} for side in sides)
        return np.array([u[i] for i in sorted(u)]) @ np.array([v[i] for i in sorted(v)]).T

    assert np.abs(scores(0) - scores(1_000_000)).max() < 1e-9


def test_an_epoch_shuffles_only_what_the_blocks_hand_back(spark, monkeypatch):
    pairs = spark.createDataFrame([(u, (u * 7 + i) % 50) for u in range(60) for i in range(5)], PAIRS)
    plans = []

    def kept(df, *by):
        if "FlatMap" in (plan := df._jdf.queryExecution().executedPlan().toString()) or "mean" in plan:
            plans.append(exchanges(df))
        return stored(df, *by)

    monkeypatch.setattr(embeddings, "stored", kept)
    embeddings.learned_retriever(pairs, rank=4, epochs=2)
    assert len(plans) == 2 and all(len(lines) == 1 and "hashpartitioning(kind" in lines[0] for lines in plans)


def test_many_vectors_are_ranked_like_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    users = [(u, (np.zeros(6) if u == 7 else rng.standard_normal(6)).tolist()) for u in range(70)]
    items = [(i, (np.round(rng.standard_normal(6), 1) * 0.98**i).tolist()) for i in range(300)]
    seen = sorted({(u, int(i)) for u in range(70) for i in rng.choice(300, u % 9, replace=False)} | {(3, i) for i in range(297)})
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (users, "user_idx bigint, vector array<double>"), (items, "item_idx bigint, vector array<double>"), (seen, PAIRS))]
    few = {tuple(r) for r in retrieval.embedding_top_k(*frames, 5).collect()}
    monkeypatch.setattr(retrieval, "MOST_MOVED_VECTORS", 0)
    monkeypatch.setattr(retrieval, "STORED_ITEMS", 30)
    monkeypatch.setattr(retrieval, "_scored_blocks", None)  # moves the vectors
    assert {tuple(r) for r in retrieval.embedding_top_k(*frames, 5, head_items=20).collect()} == few
    assert 69 * 5 < len(few) < 70 * 5


def test_vectors_of_several_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "idx bigint, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        as_bytes(df, "idx bigint").collect()


def test_shuffle_files_leave_the_disk_when_a_table_is_written(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: manager.shuffleStatuses().size()
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for write in (cut_lineage, stored, lambda df: writers.parquet_sink(df, f"{tmp_path}/t")):
        before = held()
        write(grouped.withColumn("n", F.col("count") + 1))
        assert held() == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
