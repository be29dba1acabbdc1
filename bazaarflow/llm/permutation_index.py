"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``PREFIX`` nearest pivots. Orders are posted in inverted files, one list of
(vector, place) per pivot. A query walks the lists of its own nearest pivots and adds ``PREFIX - max(place, place)`` for
each pivot in common, which is half of what the pivot takes off the footrule distance of the two orders (a pivot missing
from an order counts as placed behind it). The vectors with the least footrule distance, ``SHARE`` of a block (at least
``LEAST``) with all ties, are reranked by the exact measure in double precision.

Inner products are searched: vectors get one more component that makes all norms equal, so that nearness to pivots
follows the inner product; equal norms leave it at zero. Pivots are a bounded sample of the rows (``PIVOTS``, chosen by
hash); every row is indexed. The index is cut into blocks of ``BLOCK`` vectors by hash and queries into chunks of
``CHUNK``; each (block, chunk) is one group with its own inverted files, so tasks have a fixed size and a vector that a
third of the rows repeat is spread over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm.common import freeze

PIVOTS, PREFIX, SHARE, LEAST = 512, 64, 0.15, 400
BLOCK, CHUNK = 4096, 512


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` (doubles): without NULL ids, NULL, empty or zero vectors, NULL or non-finite components.

    Rows that repeat an id are one vector, the smallest. The most frequent length counts; other lengths are left out.
    """
    wide = F.col(vector).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.select(F.col(key).cast("bigint").alias("id"), wide.alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    )
    good = freeze(good.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return good.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    rest[rest < 1e-6 * longest] = 0.0
    return np.column_stack((vectors, rest))


def build_index(vectors: DataFrame) -> DataFrame:
    """``id, vector, order, query_order``: the nearest pivots of the extended vector, and of the vector as a query."""
    longest = vectors.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    sample = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(PIVOTS).toArrow()
    pivots = _extended(_matrix(sample["vector"]), longest) if sample.num_rows else np.empty((0, 1))
    prefix = min(PREFIX, len(pivots))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS rows

    def nearest(points: np.ndarray) -> pa.Array:
        # Elementwise sums: equal vectors get equal orders wherever they stand.
        near = np.einsum("ij,kj->ik", points, shared.value, optimize=False)
        order = np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * prefix), pa.array(order.reshape(-1)))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                own = _matrix(part.column("vector"))
                query = np.column_stack((own, np.zeros(len(own))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vector"), nearest(_extended(own, longest)), nearest(query)],
                    ["id", "vector", "order", "query_order"],
                )

    return vectors.mapInArrow(run, "id bigint, vector array<double>, order array<smallint>, query_order array<smallint>")


def _search(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Best ``k`` of one block for one chunk of queries."""
    vectors = vectors.sort_by("id")  # ties of equal vectors go to the smaller id
    ids, points, orders = vectors["id"].to_numpy(), _matrix(vectors["vector"]), _matrix(vectors["order"])
    query_ids, query_points, query_orders = queries["id"].to_numpy(), _matrix(queries["vector"]), _matrix(queries["query_order"])
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(ids) and len(query_ids):
        n, prefix = orders.shape
        flat = orders.reshape(-1)
        by_pivot = np.argsort(flat, kind="stable")
        owner, place = by_pivot // prefix, (by_pivot % prefix).astype(np.int32)
        bounds = np.searchsorted(flat[by_pivot], np.arange(flat.max() + 2))
        wanted = min(n, max(int(np.ceil(SHARE * n)), LEAST, k + 1))
        for query, point, order in zip(query_ids, query_points, query_orders, strict=True):
            common = np.zeros(n, np.int32)
            for rank, pivot in enumerate(order):
                if pivot + 1 < len(bounds):
                    low, high = bounds[pivot], bounds[pivot + 1]
                    common[owner[low:high]] += prefix - np.maximum(place[low:high], rank)
            least = np.partition(common, n - wanted)[n - wanted]
            chosen = np.flatnonzero((common >= least) & (ids != query))
            scores = (points[chosen] * point).sum(axis=1)
            best = np.argsort(-scores, kind="stable")[:k]
            out["query_id"].append(np.full(len(best), query))
            out["vec_id"].append(ids[chosen[best]])
            out["score"].append(scores[best])
    whole = {name: np.concatenate(parts) if parts else np.empty(0) for name, parts in out.items()}
    return pa.table({"query_id": pa.array(whole["query_id"].astype(np.int64)), "vec_id": pa.array(whole["vec_id"].astype(np.int64)), "score": pa.array(whole["score"].astype(np.float64))})


def nearest_vectors(rows: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose ``key`` satisfies ``queries`` (a
    condition on ``id``), by inner product, itself left out, ties to the smaller id; all candidates, if fewer.

    Rows without a usable vector (see ``usable_vectors``) neither ask nor answer. Other columns are ignored.
    """
    index = freeze(build_index(usable_vectors(rows, key, vector)), "permutations")
    asking = index.filter(queries)
    blocks = -(-index.count() // BLOCK)
    chunks = -(-asking.count() // CHUNK)

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(max(count, 1))).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(others, 1) - 1))))

    left = dealt(index.select("id", "vector", "order"), "block", blocks, "chunk", chunks)
    right = dealt(asking.select("id", "vector", "query_order"), "chunk", chunks, "block", blocks).select("id", "vector", "query_order", "chunk", "block")

    def search(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        return _search(vectors, asked, k)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
