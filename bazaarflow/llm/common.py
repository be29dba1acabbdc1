"""What the corpus operators share: table access, size-checked joins, text hashing on byte buffers, components.

Text is hashed on whole Arrow buffers: a polynomial prefix sum gives the hash of every word at once, prefix sums over
word hashes give the hash of every run of words. All arithmetic is modulo 2**64 (numpy wraps), and every value that is
compared later goes through ``mix``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.functions.scale import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
# Rows of (id) or (id, small value) that may be sent to every executor; larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000
# Bytes of text handled at a time; the arrays of one piece stay below some tens of MB whatever the text length.
PIECE = 1 << 19

U64 = np.uint64
BASE, GRAM = U64(0x9E3779B97F4A7C15 | 1), U64(0xD6E8FEB86659FD93)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: cuts the lineage and gives real sizes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm/{name}-{uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``table`` (frozen, one short row per key) to ``df``. Copied to the executors only if counted to be small."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge"), key, how)


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two columns; NULL counts as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit("second"), whole).alias("_t2")]


# --- hashing ------------------------------------------------------------------------------------------------------
def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64; the tables last used are kept."""
    if (base, n) not in _TABLES:
        if len(_TABLES) >= 4:
            _TABLES.clear()
        _TABLES[base, n] = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
    return _TABLES[base, n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of ``values[starts:ends]`` for every pair, from one prefix sum."""
    size = 1 << max(16, int(len(values)).bit_length())
    power, inverse = _power_tables(int(base), size)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def separators(data: np.ndarray) -> np.ndarray:
    """Where the bytes 0x20 and 0x09-0x0D are."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def joined_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by a line feed; and where each begins, plus the end."""
    line_feed, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
    whole = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), line_feed, nothing)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], (~separators(data)).view(np.int8), [0])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a buffer behind separators, so that no word is cut. A single word longer than a piece stays whole."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data):
            near = np.flatnonzero(separators(data[max(start, end - 4096) : end]))
            if len(near):
                end = max(start, end - 4096) + int(near[-1]) + 1
                break
            end = min(end + 4096, len(data))
        yield start, end
        start = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the offsets that separate the texts' words."""
    data, offsets = joined_texts(texts)
    hashes, starts_all = [], []
    for low, high in _pieces(data):
        part = data[low:high]
        if lower:
            part = np.where((part - np.uint8(65)) < 26, part | np.uint8(32), part)
        starts, ends = word_spans(part)
        hashes.append(mix(run_hashes(part.astype(U64) + U64(1), starts, ends, BASE) + (ends - starts).astype(U64)))
        starts_all.append(starts + low)
    words = np.concatenate(hashes) if hashes else np.empty(0, U64)
    places = np.concatenate(starts_all) if starts_all else np.empty(0, np.int64)
    return words, np.searchsorted(places, offsets)


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words; runs over a text's border have to be masked by the caller."""
    if len(words) < length:
        return np.empty(0, U64)
    starts = np.arange(len(words) - length + 1)
    return mix(run_hashes(words, starts, starts + length, GRAM))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def map_text(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to small Arrow slices of ``df`` (which has a ``text`` column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out
                # Freed blocks go back to the system: workers live on for the next stage.
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


# --- components ---------------------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``); the component is its smallest node.

    Alternating large-star and small-star steps: every step is an aggregate (combined before the shuffle, so a hub is
    no hot key) and a join on the node, and each round is written to the checkpoint folder.
    """
    current = freeze(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        after = freeze(small, "edges")
        # A star forest is reached when no smaller end is itself the larger end of another edge.
        deep = after.select(F.col("b").alias("a")).distinct().join(after.select("a").distinct(), "a", "left_semi")
        current = after
        if deep.isEmpty() and after.groupBy("a").count().filter("count > 1").isEmpty():
            break
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
