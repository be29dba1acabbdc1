"""Recommender models and top-k retrieval.

Users and items are addressed by their index tables (``user_idx``, ``item_idx``). Vectors are ``ARRAY<DOUBLE>`` columns
named ``vector``. No operator lists all user-item pairs: the candidate pool of a user is "every train item that is not in
``seen``", and it is applied as a mask while scoring.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.functions.columns import dot, l2_normalized
from bazaarflow.functions.scale import (
    beside_each,
    cut_lineage,
    ensure_checkpoint_dir,
    one_block_a_task,
    own_and_table,
    placed_by,
    rank_within,
    shuffled,
    spread_by,
    stored,
    tasks_kept_apart,
    with_ordinal,
)
from bazaarflow.functions.vectors import as_arrays, as_bytes, matrix_of, packed
from bazaarflow.schemas import SPLIT_NAMES

SEED = 42
MOST_ALS_IDS = 2**31 - 1
# Users and items meet in blocks; a block of vectors takes about so many bytes.
BLOCK_BYTES = 16 * 1024 * 1024
# Weighted pairs of one block of the factorization; with as many item rows they take about 250 MB.
BLOCK_PAIRS = 200_000
# More pairs than this are stored in blocks that read the other side's table, each of at most so many rows and pairs.
MOST_MOVED_PAIRS = 1_000_000
STORED_ROWS, STORED_PAIRS = 400_000, 8_000_000
# Copies of vectors that a search may shuffle; above that the blocks of users, each of at most so many, read the stored
# items, so many at a time.
MOST_MOVED_VECTORS = 2_000_000
STORED_USERS, STORED_ITEMS = 131_072, 32_768
# Items of the block that every user meets first.
HEAD_ITEMS = 4096
# Scores held at once by one task while it ranks (8 MB of doubles), and the users they belong to.
SCORES_IN_MEMORY = 1 << 20
TILE_USERS = 256
# Rows that a task hands back in one batch.
ROWS_HANDED_BACK = 10_000
# Pairs scored in double at once.
EXACT_AT_ONCE = 1 << 16


# --- interactions -------------------------------------------------------------------------------------------------
def split_interactions(splits: DataFrame) -> DataFrame:
    """Distinct (user, split, item) rows; every split must have some."""
    pairs = splits.filter(F.col("split").isin(*SPLIT_NAMES)).select("user_id", "split", "item_id").distinct()
    present = {row[0] for row in pairs.select("split").distinct().collect()}  # at most the three names
    absent = [name for name in SPLIT_NAMES if name not in present]
    if absent:
        raise ValueError(f"the split table holds no rows for: {', '.join(absent)}")
    return pairs


def positive_pairs(splits: DataFrame, user_index: DataFrame, item_index: DataFrame) -> DataFrame:
    """Distinct train pairs as index numbers."""
    train = splits.filter(F.col("split") == "train").select("user_id", "item_id").distinct()
    return train.join(shuffled(user_index), "user_id").join(shuffled(item_index), "item_id").select("user_idx", "item_idx")


def sampled_negatives(pairs: DataFrame, n: int, item_count: int, seed: int = SEED) -> DataFrame:
    """``n`` random items per positive pair; they may hit a positive. A hash of the pair and the draw, so repeatable."""
    draws = pairs.select("user_idx", "item_idx", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    drawn = F.pmod(F.xxhash64("user_idx", "item_idx", "draw", F.lit(seed)), F.lit(item_count).cast("bigint"))
    return draws.select("user_idx", F.col("item_idx").alias("positive_idx"), "draw", drawn.alias("negative_idx"))


# --- popularity ---------------------------------------------------------------------------------------------------
def popularity_scores(
    splits: DataFrame, item_index: DataFrame, transform: str = "log1p", distinct_users: bool = False
) -> DataFrame:
    """Train rows per item (or distinct users), damped and divided by the largest value."""
    if transform not in ("log1p", "linear"):
        raise ValueError(f"transform must be log1p or linear, not {transform}")
    train = splits.filter(F.col("split") == "train")
    if distinct_users:
        train = train.select("user_id", "item_id").distinct()
    counted = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("interactions"))
    placed = item_index.join(shuffled(counted), "item_id", "left").withColumn("interactions", F.coalesce("interactions", F.lit(0)))
    damped = F.log1p("interactions") if transform == "log1p" else F.col("interactions").cast("double")
    placed = placed.withColumn("damped", damped)
    highest = placed.agg(F.max("damped")).scalar()
    score = F.when(highest > 0, F.col("damped") / highest).otherwise(F.col("damped"))
    return placed.select("item_id", "item_idx", "interactions", score.alias("score"))


def popularity_top_k(scores: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The ``k`` most popular unseen items of each user, exact.

    Items get a global place by popularity. The j-th seen place p of a user (from 1) has p - (j - 1) unseen places before
    it; counting the seen places by that number, up to k of them, gives every place of the list: the r-th unseen place is
    r plus the seen places with at most r unseen ones before. A user holds k counts, however many items they have seen.
    """
    placed, n_items = with_ordinal(scores.select("item_idx", "score"), [F.desc("score"), F.asc("item_idx")], "place")
    if n_items == 0:
        return users.select("user_idx").limit(0).selectExpr(
            "user_idx", "CAST(0 AS BIGINT) AS rank", "CAST(0 AS BIGINT) AS item_idx", "CAST(0 AS DOUBLE) AS score"
        )
    hidden = seen.select("user_idx", "item_idx").distinct().join(shuffled(placed.select("item_idx", "place")), "item_idx")
    numbered = rank_within(hidden.select("user_idx", "place"), "user_idx", ["place"], "position")
    before = numbered.withColumn("before", F.col("place") - F.col("position") + 1).filter(F.col("before") < k)
    counts = before.groupBy("user_idx", "before").agg(F.count(F.lit(1)).alias("places"))
    shifts = counts.groupBy("user_idx").agg(F.collect_list(F.struct("before", "places")).alias("shifts"))
    wanted = users.select("user_idx").join(shuffled(shifts), "user_idx", "left")

    def place(rank):
        earlier = F.filter("shifts", lambda s: s["before"] <= rank)
        return rank + F.coalesce(F.aggregate(earlier, F.lit(0).cast("bigint"), lambda total, s: total + s["places"]), F.lit(0))

    run = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), place)
    listed = wanted.select("user_idx", F.posexplode(run).alias("pos", "place")).filter(F.col("place") < n_items)
    return listed.join(shuffled(placed), "place").select(
        "user_idx", (F.col("pos") + 1).cast("bigint").alias("rank"), "item_idx", "score"
    )


# --- matrix factorization -----------------------------------------------------------------------------------------
def tfidf_interactions(pairs: DataFrame, n_users: int, weighting: str = "tfidf") -> DataFrame:
    """Weight of each train pair: inverse user frequency of the item, each user's weights at unit length."""
    if weighting == "binary":
        return pairs.select("user_idx", "item_idx", F.lit(1.0).alias("weight"))
    if weighting != "tfidf":
        raise ValueError(f"weighting must be tfidf or binary, not {weighting}")
    frequency = pairs.groupBy("item_idx").agg(F.count(F.lit(1)).alias("users"))
    idf = frequency.select("item_idx", F.log1p(F.lit(float(n_users)) / F.greatest("users", F.lit(1))).alias("idf"))
    weighted = pairs.join(idf, "item_idx")
    length = weighted.groupBy("user_idx").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("length"))
    return weighted.join(length, "user_idx").select(
        "user_idx", "item_idx", (F.col("idf") / F.col("length")).alias("weight")
    )


def _axis(width: int) -> list[str]:
    return [f"q{i}" for i in range(width)]


def _multiply(weighted: DataFrame, by: str, to: str, table: DataFrame, width: int) -> DataFrame:
    """Sparse matrix times table: join on ``by``, weighted sums per ``to``. Plain sums combine before the shuffle."""
    joined = weighted.join(table, by)
    return joined.groupBy(to).agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in _axis(width)))


def _gram(table: DataFrame, width: int) -> np.ndarray:
    """width x width product of the table with itself: each task adds up its rows, ``width`` rows reach the driver."""
    columns = _axis(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            block = batch[columns].to_numpy(dtype=float)
            total += block.T @ block
        out = pd.DataFrame(total, columns=columns)
        out.insert(0, "i", np.arange(width))
        yield out

    schema = ", ".join(["i int", *(f"{c} double" for c in columns)])
    parts = table.select(*columns).mapInPandas(partial, schema)
    rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("i").collect()
    return np.array([row[1:] for row in rows], dtype=float)


def _rotate(table: DataFrame, key: str, width: int, rotation: np.ndarray) -> DataFrame:
    """Every row of the table times a small matrix."""
    columns, out_columns = _axis(width), _axis(rotation.shape[1])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(batch[columns].to_numpy(dtype=float) @ rotation, columns=out_columns)
            out.insert(0, key, batch[key].to_numpy())
            yield out

    return table.mapInPandas(apply, ", ".join([f"{key} bigint", *(f"{c} double" for c in out_columns)]))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Rotation that makes the columns behind ``gram`` orthonormal; directions without weight become zero."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > max(values[0], 0.0) * 1e-12
    return vectors * np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


class _PairBlocks:
    """Weighted pairs kept in hashed blocks of users: a product with them moves rows of factors, never pairs.

    A block holds whole users, about ``most`` pairs. Users with more pairs than that would not fit one; theirs are kept
    apart as ``heavy`` and multiplied by joins.
    """

    def __init__(self, weighted: DataFrame, most: int):
        degrees = weighted.groupBy("user_idx").agg(F.count(F.lit(1)).alias("pairs"))
        heavy = cut_lineage(degrees.filter(F.col("pairs") > most).select("user_idx"))
        total, large = weighted.count(), heavy.count()
        blocks = max(int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
        block = F.pmod(F.xxhash64("user_idx"), F.lit(blocks)).alias("block")
        light = weighted.join(heavy, "user_idx", "left_anti") if large else weighted
        self.heavy = cut_lineage(weighted.join(heavy, "user_idx", "left_semi")) if large else None
        self.light = placed_by(light.select(block, "user_idx", "item_idx", "weight"), "block", blocks)
        self.routes = placed_by(self.light.select("item_idx", "block").distinct(), "item_idx", blocks)

    def product(self, item_side: DataFrame, rotation: np.ndarray, width: int, to: str) -> DataFrame:
        """With the item table Z and the rotation R: user rows W Z R (``to`` user_idx), or item rows W' W Z R."""
        columns = _axis(width)

        def sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(keys, kind="stable")
            named, first = np.unique(keys[order], return_index=True)
            return named, np.add.reduceat(values[order], first, axis=0)

        def multiply(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if pairs.empty:
                return pd.DataFrame({to: np.zeros(0, dtype=np.int64), **{c: np.zeros(0) for c in columns}})
            rows = rows.sort_values("item")
            users, items = pairs["user_idx"].to_numpy(), pairs["item_idx"].to_numpy()
            weight = pairs["weight"].to_numpy(dtype=float)[:, None]
            place = np.searchsorted(rows["item"].to_numpy(), items)
            keys, result = sums(weight * rows[columns].to_numpy(dtype=float)[place], users)
            result = result @ rotation
            if to == "item_idx":
                keys, result = sums(weight * result[np.searchsorted(keys, users)], items)
            out = pd.DataFrame(result, columns=columns)
            out.insert(0, to, keys)
            return out

        schema = ", ".join([f"{to} bigint", *(f"{c} double" for c in columns)])
        sent = self.routes.join(item_side, "item_idx").select(
            F.col("block").alias("to_block"), F.col("item_idx").alias("item"), *columns
        )
        product = self.light.groupBy("block").cogroup(sent.groupBy("to_block")).applyInPandas(multiply, schema)
        if self.heavy is not None:
            by_user = _rotate(_multiply(self.heavy, "item_idx", "user_idx", item_side, width), "user_idx", width, rotation)
            other = by_user if to == "user_idx" else _multiply(self.heavy, "user_idx", "item_idx", by_user, width)
            product = product.unionByName(other)
        if to == "user_idx":
            return product
        return product.groupBy("item_idx").agg(*(F.sum(c).alias(c) for c in columns))


class _StoredPairs:
    """Weighted pairs stored twice, in blocks of whole users and in blocks of whole items: no row of factors is shuffled.

    In a product a task has the pairs of one block, reads the other side's table where it lies, batch by batch, and adds
    up the rows of its own. What is written is the product alone, however many pairs there are. Users and items with more
    than ``most_pairs`` pairs are dealt to several blocks; only their rows are added up by a shuffle.
    """

    def __init__(self, weighted: DataFrame, most_rows: int = STORED_ROWS, most_pairs: int = STORED_PAIRS):
        self.spark = weighted.sparkSession
        self.pairs, self.rows_of, self.dealt = {}, {}, {}
        for side, other in (("user_idx", "item_idx"), ("item_idx", "user_idx")):
            degrees = weighted.groupBy(side).agg(F.count(F.lit(1)).alias("pairs"))
            shape = degrees.agg(F.count(F.lit(1)).alias("rows"), F.sum("pairs").alias("pairs"), F.count_if(F.col("pairs") > most_pairs).alias("heavy")).first()
            wanted = max(self.spark.sparkContext.defaultParallelism, -(-shape["rows"] // most_rows), -(-(shape["pairs"] or 0) // most_pairs))
            parts = F.lit(1)
            placed = weighted
            if shape["heavy"]:
                heavy = degrees.filter(F.col("pairs") > most_pairs).select(side, F.ceil(F.col("pairs") / most_pairs).alias("parts"))
                placed = weighted.join(shuffled(heavy), side, "left")
                parts = F.coalesce("parts", F.lit(1))
            block = F.pmod(F.xxhash64(side, F.pmod(F.xxhash64(other), parts)), F.lit(wanted)).cast("int")
            placed = placed.select(block.alias("block"), F.col(side).alias("own"), F.col(other).alias("other"), "weight")
            self.pairs[side] = stored(one_block_a_task(placed, "block", wanted), "block")
            self.rows_of[side] = dict(self.pairs[side].groupBy("block").count().collect())  # one row per block
            self.dealt[side] = bool(shape["heavy"])

    def product(self, table: DataFrame, rotation: np.ndarray, width: int, to: str) -> DataFrame:
        """Rows ``to`` of the weights times ``table`` (stored, keyed by the other side) times a small matrix; stored.

        Both tables have their ``vector`` as bytes.
        """
        rows_of = self.rows_of[to]
        key = "item_idx" if to == "user_idx" else "user_idx"

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, own, rest = own_and_table(batches, "block", rows_of)
            names, place = np.unique(own["own"].to_numpy(), return_inverse=True)
            other, weight = own["other"].to_numpy(), own["weight"].to_numpy()
            order = np.argsort(other, kind="stable")
            other, weight, place = other[order], weight[order], place[order]
            total = np.zeros((len(names), width))
            for batch in rest:
                ids = batch.column(key).to_numpy()
                first = np.searchsorted(other, ids, "left")
                found = np.searchsorted(other, ids, "right") - first
                count = int(found.sum())
                if not count:
                    continue
                at = np.repeat(first - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(count)
                source = np.repeat(np.arange(len(ids)), found)
                order = np.argsort(place[at], kind="stable")
                at, source = at[order], source[order]
                touched, start = np.unique(place[at], return_index=True)
                total[touched] += np.add.reduceat(weight[at, None] * matrix_of(batch.column("vector"), width)[source], start, axis=0)
            total = total @ rotation
            for low in range(0, len(names), ROWS_HANDED_BACK):
                part = slice(low, low + ROWS_HANDED_BACK)
                yield pa.RecordBatch.from_arrays([pa.array(names[part]), packed(total[part])], [to, "vector"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("parts")
                sizes = lists.value_lengths().to_numpy()
                parts = matrix_of(lists.flatten(), width)
                sums = np.add.reduceat(parts, np.cumsum(sizes) - sizes, axis=0) if len(sizes) else parts
                yield pa.RecordBatch.from_arrays([batch.column(to), packed(sums)], [to, "vector"])

        schema = f"{to} bigint, vector binary"
        with tasks_kept_apart(self.spark):
            done = stored(beside_each(self.pairs[to], table, "block", sorted(rows_of)).mapInArrow(multiply, schema))
        if not self.dealt[to]:
            return done
        return stored(done.groupBy(to).agg(F.collect_list("vector").alias("parts")).mapInArrow(added, schema))


def _packed_start(ids: DataFrame, width: int, seed: int) -> DataFrame:
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_idx")
            draws = [np.random.default_rng([seed, i]).standard_normal(width) for i in names.to_pylist()]
            yield pa.RecordBatch.from_arrays([names, packed(np.array(draws).reshape(len(names), width))], ["item_idx", "vector"])

    return ids.mapInArrow(start, "item_idx bigint, vector binary")


def _stored_factors(weighted: DataFrame, rank: int, width: int, n_iter: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """:func:`mf_factors` for many pairs: the tables lie in storage as bytes, and both halves of a round are written."""
    blocks = _StoredPairs(weighted)

    def wide(table: DataFrame, key: str, rotation: np.ndarray) -> DataFrame:
        def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(key), packed(matrix_of(batch.column("vector"), width) @ rotation)], [key, "vector"])

        return as_arrays(table.mapInArrow(rotate, f"{key} bigint, vector binary"), f"{key} bigint", rotation.shape[1])

    def gram(table: DataFrame) -> np.ndarray:
        columns = _axis(width)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                rows = matrix_of(batch.column("vector"), width)
                total += rows.T @ rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], ["i", *columns])

        parts = table.mapInArrow(partial, ", ".join(["i int", *(f"{c} double" for c in columns)]))
        rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("i").collect()
        return np.array([row[1:] for row in rows], dtype=float)

    item_side = stored(_packed_start(spread_by(weighted.select("item_idx").distinct(), "item_idx"), width, seed))
    rotation = np.eye(width)
    for _ in range(max(1, n_iter)):
        user_side = blocks.product(item_side, rotation, width, "user_idx")
        item_side = blocks.product(user_side, np.eye(width), width, "item_idx")
        rotation = _whitening(gram(item_side))
    user_side = blocks.product(item_side, rotation, width, "user_idx")
    values, vectors = np.linalg.eigh(gram(user_side))
    leading = vectors[:, np.argsort(values)[::-1][:rank]]
    return stored(wide(user_side, "user_idx", leading)), stored(wide(item_side, "item_idx", rotation @ leading))


def mf_factors(
    weighted_pairs: DataFrame,
    n_users: int,
    n_items: int,
    components: int = 64,
    n_iter: int = 5,
    seed: int = SEED,
    block_pairs: int = BLOCK_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """Truncated SVD of the user-item matrix: user rows of U*S and item rows of V, as ``(idx, vector)`` tables.

    Randomized subspace iteration with both factor tables distributed. The pairs are placed once, in blocks. Up to
    ``MOST_MOVED_PAIRS`` of them, a round sends each item row to the blocks that hold the item and adds up what comes back;
    more would move a row of factors per pair, so there the blocks read the tables instead. Only small square matrices
    (components + 10) reach the driver. Each round is written out, so a lost executor repeats one round, not all of them.
    Users without train pairs have no row here and count as zero vectors.
    """
    rank = max(2, min(components, min(n_users, n_items) - 1))
    width = min(rank + 10, max(n_items, 2))
    weighted = cut_lineage(weighted_pairs.select("user_idx", "item_idx", "weight"))
    if weighted.count() > MOST_MOVED_PAIRS:
        return _stored_factors(weighted, rank, width, n_iter, seed)
    blocks = _PairBlocks(weighted, block_pairs)
    columns = _axis(width)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["item_idx"].to_numpy()
            draws = [np.random.default_rng([seed, int(i)]).standard_normal(width) for i in ids]
            out = pd.DataFrame(np.array(draws).reshape(len(ids), width), columns=columns)
            out.insert(0, "item_idx", ids)
            yield out

    schema = ", ".join(["item_idx bigint", *(f"{c} double" for c in columns)])
    # Written out, so that its size is known: the ids are short, the rows made of them are not.
    item_side = cut_lineage(spread_by(weighted.select("item_idx").distinct(), "item_idx").mapInPandas(start, schema))
    rotation = np.eye(width)
    for _ in range(max(1, n_iter)):
        item_side = cut_lineage(blocks.product(item_side, rotation, width, "item_idx"))
        rotation = _whitening(_gram(item_side, width))
    user_side = cut_lineage(blocks.product(item_side, rotation, width, "user_idx"))
    values, vectors = np.linalg.eigh(_gram(user_side, width))
    leading = vectors[:, np.argsort(values)[::-1][:rank]]
    kept = _axis(leading.shape[1])
    users = _rotate(user_side, "user_idx", width, leading).select("user_idx", F.array(*kept).alias("vector"))
    items = _rotate(item_side, "item_idx", width, rotation @ leading).select("item_idx", F.array(*kept).alias("vector"))
    return cut_lineage(users), cut_lineage(items)


# --- alternating least squares -------------------------------------------------------------------------------------------
def als_retriever(
    pairs: DataFrame,
    rank: int = 64,
    seed: int = SEED,
    reg: float = 0.1,
    alpha: float = 40.0,
    max_iter: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """User and item embeddings learned from binary positives by alternating least squares, at unit length."""
    ensure_checkpoint_dir(pairs.sparkSession)
    highest = pairs.agg(F.max(F.greatest("user_idx", "item_idx"))).first()[0] or 0
    if highest > MOST_ALS_IDS:
        raise ValueError(f"alternating least squares takes 32-bit ids, the index reaches {highest}")
    blocks = max(2, pairs.sparkSession.sparkContext.defaultParallelism)
    als = ALS(
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="rating",
        implicitPrefs=True,
        rank=rank,
        regParam=reg,
        alpha=alpha,
        maxIter=max_iter,
        seed=seed,
    )
    # A fixed placement and order of the pairs makes equal seeds give equal factors.
    rows = pairs.select(F.col("user_idx").cast("int").alias("user_idx"), F.col("item_idx").cast("int").alias("item_idx"))
    rows = rows.repartition("user_idx", "item_idx").sortWithinPartitions("user_idx", "item_idx")
    model = als.fit(rows.withColumn("rating", F.lit(1.0)))

    def unit(factors: DataFrame, name: str) -> DataFrame:
        return cut_lineage(factors.select(F.col("id").cast("bigint").alias(name), l2_normalized(F.col("features")).alias("vector")))

    return unit(model.userFactors, "user_idx"), unit(model.itemFactors, "item_idx")


def l2_normalize_rows(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """Each vector divided by its length."""
    return df.withColumn(vec_col, l2_normalized(F.col(vec_col)))


# --- scoring ------------------------------------------------------------------------------------------------------
def candidate_items(users: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """Size of each user's candidate pool: all indexed items minus the seen ones. The pool itself is never listed."""
    hidden = seen.join(items.select("item_idx"), "item_idx").groupBy("user_idx").agg(F.count(F.lit(1)).alias("seen_items"))
    universe = items.agg(F.count(F.lit(1))).scalar()
    pool = users.select("user_idx").join(hidden, "user_idx", "left").withColumn(
        "seen_items", F.coalesce("seen_items", F.lit(0))
    )
    return pool.withColumn("candidate_items", universe - F.col("seen_items"))


def dot_product_scores(user_vecs: DataFrame, item_vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inner product of the two vectors of every given pair."""
    left = user_vecs.select("user_idx", F.col("vector").alias("user_vector"))
    right = item_vecs.select("item_idx", F.col("vector").alias("item_vector"))
    joined = pairs.join(left, "user_idx").join(right, "item_idx")
    return joined.select("user_idx", "item_idx", dot(F.col("user_vector"), F.col("item_vector")).alias("score"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float, copy=False) if len(vectors) else np.empty((0, 0))


def _short_form(users: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Users at unit length and items over the longest one as single floats; per user what undoes that, and the error.

    The error bounds how far a product of the short forms may be from the true one. Vectors that are not finite, or too
    long or short to be scaled, stay as they are; then the products are the scores themselves and the error is 0.
    """
    lengths, longest = np.linalg.norm(users, axis=1), np.linalg.norm(items, axis=1).max()
    sizes = np.append(lengths, longest)
    if not ((sizes == 0) | ((sizes > 1e-100) & (sizes < 1e100))).all():
        return users, items, np.ones(len(users)), np.zeros(len(users))
    one = np.where(lengths > 0, lengths, 1.0)
    # Rounding both vectors and adding up dim products: less than dim + 3 roundings of 2**-24 each; twice that is allowed.
    error = np.where(lengths > 0, (items.shape[1] + 8) * 2.0**-23, 0.0)
    return (users / one[:, None]).astype(np.float32), (items / (longest or 1.0)).astype(np.float32), one * (longest or 1.0), error


def _set_places(flags: np.ndarray) -> np.ndarray:
    """Where few of many flags are set: eight are looked at together."""
    body = len(flags) // 8 * 8
    places = np.flatnonzero(flags[:body].view(np.uint64))[:, None] * 8 + np.arange(8)
    places = np.append(places.ravel(), np.arange(body, len(flags)))
    return places[flags[places]]


def _rank_block(
    user_ids: np.ndarray, users: np.ndarray, hidden: list, item_ids: np.ndarray, items: np.ndarray, k: int, floor: np.ndarray | None = None
) -> pd.DataFrame:
    """Best ``k`` unseen items per user of one block; ``item_ids`` ascending, so equal scores go in item order.

    Users and items meet in small tiles, as single floats first. Only pairs that may, by the bound on the error, exceed a
    user's worst listed score are scored in double; an equal score of a later item never moves an earlier one. Scores
    below ``floor``, one per user, are left out.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    tile_items = max(1, SCORES_IN_MEMORY // TILE_USERS)
    short_users, short_items, by, error = _short_form(users, items)
    whole = short_users is users
    # The tiles share their memory: fresh memory for each would cost as much as the products.
    scores, flags = np.empty(TILE_USERS * tile_items, short_users.dtype), np.empty(TILE_USERS * tile_items, bool)
    lowest = np.full(len(users), -np.inf) if floor is None else np.where(np.isnan(floor), -np.inf, floor)
    for begin in range(0, len(user_ids), TILE_USERS):
        own = slice(begin, begin + TILE_USERS)
        part, short, least, slack, unit = users[own], short_users[own], lowest[own], error[own], by[own]
        gone = [np.asarray([] if ids is None else ids, dtype=np.int64) for ids in hidden[own]]
        gone_rows, gone_ids = np.repeat(np.arange(len(gone)), [len(ids) for ids in gone]), np.concatenate(gone)
        gone_at = np.searchsorted(item_ids, gone_ids)
        known = (gone_at < len(item_ids)) & (item_ids[np.minimum(gone_at, len(item_ids) - 1)] == gone_ids)
        gone_rows, gone_at = gone_rows[known], gone_at[known]
        rows, at, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(len(part), -np.inf)
        level = np.zeros(len(part), bool) if whole else slack == 0  # all scores of a zero vector are equal
        limit = np.nextafter((least / unit - slack).astype(short.dtype), -np.inf, dtype=short.dtype)
        for low in range(0, len(item_ids), tile_items):
            tile = short_items[low : low + tile_items]
            cells = len(part) * len(tile)
            near = np.matmul(short, tile.T, out=scores[:cells].reshape(len(part), len(tile)))
            inside = (gone_at >= low) & (gone_at < low + tile_items)
            near[gone_rows[inside], gone_at[inside] - low] = -np.inf
            better = np.greater(near, limit[:, None], out=flags[:cells].reshape(len(part), len(tile)))
            if near.shape[1] > k and np.count_nonzero(better) > 4 * k * len(part):
                kth = np.partition(near, -k, axis=1)[:, -k]
                better &= near >= (kth - 2 * slack).astype(short.dtype)[:, None]
                better[level] &= np.cumsum(better[level], axis=1) <= k
            places = _set_places(flags[:cells])
            if not len(places):
                continue
            new_rows, new_at = places // near.shape[1], places % near.shape[1]
            if whole:
                exact = near[new_rows, new_at]
            else:
                chunks = [slice(i, i + EXACT_AT_ONCE) for i in range(0, len(places), EXACT_AT_ONCE)]
                exact = np.concatenate([np.einsum("nd,nd->n", part[new_rows[c]], items[new_at[c] + low]) for c in chunks])
            wanted = (exact > worst[new_rows]) & (exact >= least[new_rows])
            new_rows, new_at, exact = new_rows[wanted], new_at[wanted], exact[wanted]
            if not len(new_rows):
                continue
            rows, at, values = np.append(rows, new_rows), np.append(at, new_at + low), np.append(values, exact)
            order = np.lexsort((at, -values, rows))
            rows, at, values = rows[order], at[order], values[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, at, values, place = (column[place < k] for column in (rows, at, values, place))
            worst[rows[place == k - 1]] = values[place == k - 1]
            limit = np.maximum(limit, (worst / unit - slack).astype(short.dtype))
        found.append((user_ids[begin + rows], item_ids[at], values))
    return pd.DataFrame(dict(zip(("user_idx", "item_idx", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


_RANKED = "user_idx bigint, item_idx bigint, score double"


def _best_k(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("user_idx").orderBy(F.desc("score"), F.asc("item_idx"))
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("user_idx", F.col("rank").cast("bigint").alias("rank"), "item_idx", "score")


def _scored_blocks(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, user_blocks: int) -> DataFrame:
    """Users (``user_idx, vector, worst, item_block``) against items (``item_idx, vector, item_block``), block by block.

    A block of users meets a block of items in one task and keeps ``k`` rows per user; the lists of the item blocks are
    merged by the caller. Scores below ``worst`` (NULL: none) cannot enter a user's list and are not handed back. Blocks
    are cut by hash of unique ids, so their sizes are even whatever the data looks like.
    """
    block = F.pmod(F.xxhash64("user_idx"), F.lit(user_blocks)).cast("int")
    places = items.select("item_idx", "item_block")
    hidden = seen.join(places, "item_idx").groupBy("user_idx", "item_block").agg(F.collect_set("item_idx").alias("hidden"))
    left = users.join(hidden, ["user_idx", "item_block"], "left").withColumn("user_block", block)
    right = items.withColumn("user_block", F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))))

    def rank(user_part: pd.DataFrame, item_part: pd.DataFrame) -> pd.DataFrame:
        if user_part.empty or item_part.empty:
            return pd.DataFrame({"user_idx": [], "item_idx": [], "score": []})
        item_part = item_part.sort_values("item_idx")
        return _rank_block(
            user_part["user_idx"].to_numpy(),
            _matrix(user_part["vector"]),
            list(user_part["hidden"]),
            item_part["item_idx"].to_numpy(),
            _matrix(item_part["vector"]),
            k,
            user_part["worst"].to_numpy(dtype=float),
        )

    keys = ["user_block", "item_block"]
    return spread_by(left, *keys).groupBy(*keys).cogroup(spread_by(right, *keys).groupBy(*keys)).applyInPandas(rank, _RANKED)


def _per_block(dim: int, block_bytes: int) -> int:
    return max(1, block_bytes // (8 * max(dim, 1)))


def _within_reach(users: DataFrame, first: DataFrame, bounds: list[tuple[int, float]], k: int) -> DataFrame:
    """``user_idx, vector, worst, item_block`` for the blocks that may change a user's list.

    No score of a block exceeds the user's length times the block's longest vector (``bounds``, one entry per block of
    items); a block is left out where that is below the worst of the ``k`` scores the user already has.
    """
    worst = first.groupBy("user_idx").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
    length = F.sqrt(dot(F.col("vector"), F.col("vector")))
    asking = users.select("user_idx", "vector", length.alias("length")).join(worst, "user_idx", "left")
    blocks = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(longest).alias("longest")) for b, longest in bounds))
    # Rounding may lift a score above the product of the lengths by a few units in the last place.
    near = F.filter(blocks, lambda b: F.col("worst").isNull() | (F.col("length") * b["longest"] * (1 + 1e-9) >= F.col("worst")))
    return asking.select("user_idx", "vector", "worst", F.explode(F.transform(near, lambda b: b["block"])).alias("item_block"))


def _streamed_lists(
    users: np.ndarray, hidden: list, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` unseen items per row of ``users``, as rows (from 0), items and scores; the items come in ``parts``.

    A part meets only the users whose length times its longest vector reaches the worst score of a full list.
    """
    lengths = np.linalg.norm(users, axis=1)
    rows, found, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    worst = np.full(len(users), np.nan)  # NaN: the list is not full
    for item_ids, items in parts:
        order = np.argsort(item_ids, kind="stable")
        item_ids, items = item_ids[order], items[order]
        # Rounding may lift a score above the product of the lengths by a few units in the last place.
        asking = np.flatnonzero(~(lengths * np.linalg.norm(items, axis=1).max() * (1 + 1e-9) < worst))
        if not len(asking):
            continue
        scored = _rank_block(asking, users[asking], [hidden[i] for i in asking], item_ids, items, k, worst[asking])
        changed = np.zeros(len(users), bool)
        changed[scored["user_idx"].to_numpy()] = True
        old = changed[rows]
        kept = [column[~old] for column in (rows, found, values)]
        rows, found, values = (
            np.append(column[old], scored[name].to_numpy()) for column, name in ((rows, "user_idx"), (found, "item_idx"), (values, "score"))
        )
        order = np.lexsort((found, -values, rows))
        rows, found, values = rows[order], found[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, found, values, place = (column[place < k] for column in (rows, found, values, place))
        worst[rows[place == k - 1]] = values[place == k - 1]
        rows, found, values = (np.append(column, more) for column, more in zip(kept, (rows, found, values), strict=True))
    return rows, found, values


def _stored_top_k(user_vecs: DataFrame, items: DataFrame, seen: DataFrame, k: int, dim: int, users: int) -> DataFrame:
    """:func:`embedding_top_k` for many vectors: every block of users reads the items where they lie, longest ones first.

    No vector of an item is shuffled, and a user's list is whole when it leaves its task. ``items`` has ``item_block``, and
    its rows in the order of their lengths.
    """
    spark = user_vecs.sparkSession
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(users / STORED_USERS))
    hidden = seen.groupBy("user_idx").agg(F.collect_set("item_idx").alias("hidden"))
    block = F.pmod(F.xxhash64("user_idx"), F.lit(blocks)).cast("int").alias("block")
    asking = user_vecs.join(shuffled(hidden), "user_idx", "left").select(block, "user_idx", "hidden", "vector")
    own = stored(one_block_a_task(as_bytes(asking, "block int, user_idx bigint, hidden array<bigint>"), "block", blocks), "block")
    rows_of = dict(own.groupBy("block").count().collect())  # one row per block
    head, others = (stored(as_bytes(items.filter(part).select("item_idx", "vector"), "item_idx bigint")) for part in ("item_block = 0", "item_block > 0"))

    def in_parts(rest: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(rest, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(part.num_rows for part in held) >= STORED_ITEMS):
                yield np.concatenate([part.column("item_idx").to_numpy() for part in held]), np.concatenate([matrix_of(part.column("vector"), dim) for part in held])
                held = []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, mine, rest = own_and_table(batches, "block", rows_of)
        vectors = np.concatenate([matrix_of(chunk, dim) for chunk in mine["vector"].chunks])
        rows, found, values = _streamed_lists(vectors, mine["hidden"].to_pylist(), in_parts(rest), k)
        names = mine["user_idx"].combine_chunks()
        for low in range(0, len(rows), ROWS_HANDED_BACK):
            part = slice(low, low + ROWS_HANDED_BACK)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[part])), pa.array(found[part]), pa.array(values[part])], ["user_idx", "item_idx", "score"])

    lists = beside_each(own, head.unionByName(others), "block", sorted(rows_of)).mapInArrow(search, _RANKED)
    with tasks_kept_apart(spark):
        return stored(_best_k(lists, k))


def embedding_top_k(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    seen: DataFrame,
    k: int,
    block_bytes: int = BLOCK_BYTES,
    head_items: int = HEAD_ITEMS,
) -> DataFrame:
    """Exact ``k`` best unseen items per user by inner product, ranked from 1. No items give no rows.

    Items are sorted by length and cut into blocks. Every user meets the block of the longest vectors first; after that
    only the blocks whose vectors are long enough to beat the list found there. Users are cut into as many blocks as it
    takes to keep all cores at work. Where the copies of vectors that blocks take would be more than
    ``MOST_MOVED_VECTORS``, the blocks read the items where they are stored instead.
    """
    shape = item_vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if not shape["n"]:
        return _best_k(user_vecs.limit(0).selectExpr("user_idx", "user_idx AS item_idx", "CAST(0 AS DOUBLE) AS score"), k)
    per_block = _per_block(shape["dim"], block_bytes)
    head = min(per_block, max(head_items, 2 * k))
    measured = item_vecs.select("item_idx", "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("length"))
    placed, _ = with_ordinal(measured, [F.desc("length"), "item_idx"], "place")
    block = F.when(F.col("place") < head, 0).otherwise(1 + F.floor((F.col("place") - head) / per_block)).cast("int")
    items = cut_lineage(placed.select("item_idx", "vector", "length", block.alias("item_block")))
    tasks = user_vecs.sparkSession.sparkContext.defaultParallelism
    n_users = user_vecs.count()
    by_size = math.ceil(n_users / per_block)
    if by_size * shape["n"] + n_users * math.ceil(shape["n"] / per_block) > MOST_MOVED_VECTORS:
        return _stored_top_k(user_vecs.select("user_idx", "vector"), items, seen, k, shape["dim"], n_users)
    everyone = user_vecs.select("user_idx", "vector", F.lit(None).cast("double").alias("worst"), F.lit(0).alias("item_block"))
    first = cut_lineage(_scored_blocks(everyone, items.filter("item_block = 0").drop("length"), seen, k, max(by_size, tasks)))
    others = items.filter("item_block > 0")
    bounds = [tuple(row) for row in others.groupBy("item_block").agg(F.max("length")).orderBy("item_block").collect()]
    if not bounds:
        return _best_k(first, k)
    routed = _within_reach(user_vecs, first, bounds, k)
    rest = _scored_blocks(routed, others.drop("length"), seen, k, max(by_size, math.ceil(tasks / len(bounds))))
    return _best_k(first.unionByName(rest), k)


def approx_top_k(
    user_vecs: DataFrame,
    item_vecs: DataFrame,
    seen: DataFrame,
    k: int,
    probes: int = 8,
    seed: int = SEED,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate inner-product retrieval: items are clustered, a user is scored only against the nearest clusters.

    At least ``probes`` clusters are probed, and as many more as it takes to hold ``k`` items besides the seen ones, so
    every list is as long as an exact one. Scores are exact and seen items are masked; what can be missed are items of
    clusters that were not probed. A cluster that holds very many items is cut into several blocks.
    """
    shape = item_vecs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    cells = math.isqrt(shape["n"])
    if cells < 2:  # up to three items: nothing to cluster
        return embedding_top_k(user_vecs, item_vecs, seen, k, block_bytes)
    per_block = _per_block(shape["dim"], block_bytes)
    vectors = item_vecs.select("item_idx", "vector", array_to_vector("vector").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(vectors)
    centers = np.array(model.clusterCenters())
    assigned = cut_lineage(model.transform(vectors).select("item_idx", "vector", "cell"))
    # One row per cluster (the square root of the item count): how many blocks it needs, and where they start.
    first_block, blocks_of, sizes = {}, {}, []
    for row in assigned.groupBy("cell").count().orderBy("cell").collect():
        first_block[row["cell"]] = sum(blocks_of.values())
        blocks_of[row["cell"]] = math.ceil(row["count"] / per_block)
        sizes.append(row["count"])
    table = [(cell, first_block[cell], blocks_of[cell]) for cell in first_block]
    layout = item_vecs.sparkSession.createDataFrame(table, "cell int, first_block int, blocks int")
    slot = F.pmod(F.xxhash64("item_idx"), F.col("blocks")).cast("int")
    items = assigned.join(layout, "cell").select(
        "item_idx", "vector", (F.col("first_block") + slot).cast("int").alias("item_block")
    )
    known, held = np.array([cell for cell, _, _ in table]), np.array(sizes)
    taken = seen.groupBy("user_idx").agg(F.count(F.lit(1)).alias("taken"))
    asking = user_vecs.select("user_idx", "vector").join(taken, "user_idx", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(-(_matrix(batch["vector"]) @ centers[known].T), axis=1, kind="stable")
            reached = np.cumsum(held[order], axis=1)
            needed = (reached < (k + batch["taken"].to_numpy())[:, None]).sum(axis=1) + 1
            chosen = [known[row[: max(probes, n)]].astype("int32") for row, n in zip(order, needed, strict=True)]
            yield batch[["user_idx", "vector"]].assign(cells=chosen)

    routed = stored(asking.mapInPandas(probe, "user_idx bigint, vector array<double>, cells array<int>"))
    routed = routed.select("user_idx", "vector", F.explode("cells").alias("cell")).join(layout, "cell")
    every = F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("blocks") - 1)).alias("item_block")
    users = routed.select("user_idx", "vector", F.lit(None).cast("double").alias("worst"), every)
    user_blocks = max(1, math.ceil(user_vecs.count() / per_block))
    if user_blocks > 1:  # items are copied once per block of users, and a cell seldom meets more than a few of the users
        fullest = users.groupBy("item_block").count().agg(F.max("count")).first()[0] or 1
        user_blocks = math.ceil(fullest / per_block)
    return _best_k(_scored_blocks(users, items, seen, k, user_blocks), k)


# --- serving tables -----------------------------------------------------------------------------------------------
def item_embedding_table(factors: DataFrame, item_index: DataFrame, model_name: str) -> DataFrame:
    """Serving table of item vectors. Items without a vector are left out."""
    return factors.join(item_index, "item_idx").select("item_id", "item_idx", "vector", F.lit(model_name).alias("model_name"))


def with_zero_vectors(user_index: DataFrame, user_vecs: DataFrame, dim: int) -> DataFrame:
    """A vector for every indexed user: those without train pairs get zeros and so follow the item order."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return user_index.select("user_idx").join(user_vecs, "user_idx", "left").select(
        "user_idx", F.coalesce("vector", zeros).alias("vector")
    )


def topk_recommendations(
    model_name: str, ranked: DataFrame, user_index: DataFrame, item_index: DataFrame
) -> DataFrame:
    """Ranked index pairs as the serving table ``(user_id, rank, item_id, score, model_name)``."""
    named = ranked.join(shuffled(user_index), "user_idx").join(shuffled(item_index.select("item_idx", "item_id")), "item_idx")
    return named.select(
        "user_id", "rank", "item_id", F.round("score", 6).alias("score"), F.lit(model_name).alias("model_name")
    )
