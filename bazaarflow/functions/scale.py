"""Building blocks that keep ordered and skewed work distributed.

Spark evaluates a window without ``partitionBy`` in one task, so global positions and running totals are built from a
range-partitioned sort instead: the sorted rows are frozen once, every block counts itself, and the per-block offsets
(one row per block, never more than the number of shuffle partitions) are added back.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tasks carry the functions they run, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="bazaarflow-checkpoint-")
    context.setCheckpointDir(configured)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the steps inside; one that this version of Spark lacks stays unset afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_released(spark: SparkSession):
    """The shuffle files of a write leave the disk when it has ended, not when the driver next collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder: later steps survive lost executors and do not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan keeps the settings it was made under


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet below the checkpoint folder, for wide tables that are read often; in folders of ``by``.

    A later step reads only the columns it names and the rows it filters; a checkpoint is read whole every time. Joins that
    follow should name their sides that grow (see :func:`shuffled`), as the size of the files is known to the optimizer.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored/{uuid4()}"
    with shuffles_released(spark):
        df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def beside_each(own: DataFrame, table: DataFrame, key: str, blocks: Sequence[int]) -> DataFrame:
    """A task for each of ``blocks``: the rows of ``own`` whose ``key`` it is, and all rows of ``table``. Nothing is shuffled.

    For a table that every block needs nearly whole: it is read where it lies, while a shuffle would write a copy of it for
    every block. ``own`` should be stored by ``key`` (a whole number), ``table`` as it is. A column that one side lacks is
    NULL in its rows, ``key`` in those of the table. Use it inside :func:`tasks_kept_apart`.
    """
    parts = [own.filter(F.col(key) == block).unionByName(table, allowMissingColumns=True).coalesce(1) for block in blocks]
    return reduce(DataFrame.unionByName, parts)


def tasks_kept_apart(spark: SparkSession):
    """Where a plan made of :func:`beside_each` is run: a union must not merge the single tasks of its sides into one."""
    return _setting(spark, "spark.sql.unionOutputPartitioning", "false")


def own_and_table(batches: Iterator[pa.RecordBatch], key: str, rows_of: Mapping[int, int]) -> tuple[int, pa.Table, Iterator[pa.RecordBatch]]:
    """In a task of :func:`beside_each`: its block, the block's own rows, and the rows of the table batch by batch.

    ``rows_of`` has the number of rows of every block. They come first as a rule; rows of the table before them are kept.
    """
    own, early, got, held = [], [], 0, set()
    for batch in batches:
        mine = pc.is_valid(batch.column(key))
        own.append(batch.filter(mine))
        early.append(batch.filter(pc.invert(mine)))
        got += own[-1].num_rows
        held.update(pc.unique(own[-1].column(key)).to_pylist())
        if len(held) > 1:
            raise RuntimeError(f"blocks {sorted(held)} met in one task")
        if held and got == rows_of[min(held)]:
            break

    def rest() -> Iterator[pa.RecordBatch]:
        while early:
            yield early.pop(0)
        yield from batches

    return min(held), pa.Table.from_batches(own), rest()


def placed_by(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """``df`` hash-partitioned by ``key`` and written to the checkpoint folder: later steps on ``key`` leave it in place.

    Only a plan that is not adaptive tells how its rows lie, so adaptive execution is off while this one is written.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(partitions, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into a fixed number of tasks, for few short rows that are much work.

    Adaptive execution merges tasks by the bytes they read, so it would leave such work to a handful of cores.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def one_block_a_task(df: DataFrame, block: str, blocks: int) -> DataFrame:
    """``df`` with every block (an INT column, numbered from 0) in a task of its own.

    For few blocks that are much work each: hashed, several would meet in one task while other cores are idle.
    """
    return df.repartitionById(blocks, F.col(block))


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: it is shuffled, never collected and copied to all executors.

    The optimizer goes by an estimate that may be a small part of the true size, and a copy passes through the driver.
    """
    return df.hint("merge")


def sorted_blocks(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Globally sorted rows with ``_block`` (range partition) and ``_pos`` (place inside the block).

    ``order`` should end in a unique key: then a value shared by many rows is still spread over several blocks.
    """
    numbered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    # monotonically_increasing_id keeps the partition in the upper bits and the row number in the lower 33.
    placed = numbered.select(
        *df.columns,
        F.shiftright("_mid", 33).alias("_block"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    return cut_lineage(placed)


def _with_offsets(blocks: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``blocks`` with ``_before_<name>``, the totals of all earlier blocks; and the grand totals.

    One row per block goes to the driver and back as a small table that is copied to the executors. Totals are whole
    numbers.
    """
    rows = blocks.groupBy("_block").agg(*(expr.alias(name) for name, expr in sums.items())).collect()
    by_block = {row["_block"]: row for row in rows}
    offsets, running = [], dict.fromkeys(sums, 0)
    for block in sorted(by_block):
        offsets.append((block, *running.values()))
        for name in sums:
            running[name] += int(by_block[block][name] or 0)
    schema = ", ".join(["_block bigint", *(f"`_before_{name}` bigint" for name in sums)])
    table = blocks.sparkSession.createDataFrame(offsets, schema)
    return blocks.join(F.broadcast(table), "_block"), running  # one row per sort block


def with_ordinal(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal") -> tuple[DataFrame, int]:
    """Add the 0-based global position under ``order``; also return the row count."""
    blocks = sorted_blocks(df, order)
    placed, totals = _with_offsets(blocks, {"rows": F.count(F.lit(1))})
    return placed.select(*df.columns, (F.col("_pos") + F.col("_before_rows")).alias(name)), totals["rows"]


def with_running_totals(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]
) -> tuple[DataFrame, dict[str, int]]:
    """Add inclusive running totals under ``order``: ``sums`` maps each new column to a whole-number column.

    Also returns the grand totals.
    """
    blocks = sorted_blocks(df, order)
    placed, totals = _with_offsets(blocks, {name: F.sum(column) for name, column in sums.items()})
    inside = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [(F.sum(column).over(inside) + F.col(f"_before_{name}")).alias(name) for name, column in sums.items()]
    return placed.select(*df.columns, *running), totals


def rank_within(df: DataFrame, key: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based position of each row inside its ``key`` group, without putting a whole group into one task.

    The sort runs over (key, order), so a huge group spans several blocks; only the groups that do span blocks need an
    offset, and there are at most two of them per block.
    """
    blocks = sorted_blocks(df, [F.col(key), *order])
    per_block = blocks.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
    spanning = per_block.groupBy(key).agg(F.count(F.lit(1)).alias("_spans")).filter("_spans > 1").select(key)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.join(spanning, key, "left_semi").select(
        key, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_carried")
    )
    placed = blocks.join(shuffled(per_block.select(key, "_block", "_first")), [key, "_block"]).join(
        carried, [key, "_block"], "left"
    )
    position = F.col("_pos") - F.col("_first") + F.coalesce("_carried", F.lit(0)) + 1
    return placed.select(*df.columns, position.alias(name))


def top_rows(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows under ``order`` (which must end in a unique key), exact for any ``k``: no task merges lists."""
    placed, _ = with_ordinal(df, order, "_place")
    return placed.filter(F.col("_place") < k).drop("_place")


# Bins a column is cut into by one pass, and the rows at which narrowing stops: so few are sorted at once.
CUT_BINS = 2048
CUT_BORDER = 65_536


@dataclass(frozen=True)
class Cut:
    """Where the ``k`` largest values end: all rows of ``above``, and ``wanted`` of the ``border_rows`` rows of ``border``."""

    above: Column
    border: Column
    wanted: int
    border_rows: int


def _magnitude(value: Column) -> Column:
    """Whole number that never falls as ``value`` grows: NULL first, then numbers by sign and power of two, NaN last."""

    def power(positive: Column) -> Column:
        return F.floor(F.least(F.log2(positive), F.lit(1100.0))).cast("int") + 1200

    return (
        F.when(value.isNull(), -9999)
        .when(F.isnan(value), 9999)
        .when(value > 0, power(value))
        .when(value < 0, -power(-value))
        .otherwise(0)
    )


def top_cuts(df: DataFrame, columns: Sequence[str], k: int, border_rows: int = CUT_BORDER) -> dict[str, Cut]:
    """For each double column, where its ``k`` largest values end (descending order: NaN first, NULL last), unsorted.

    Every pass counts rows by bin for all columns at once: by power of two first, then by equal steps between the
    smallest and the largest value of the bin that holds the k-th row. At most ``CUT_BINS`` (2,400 at first) counts a
    column reach the driver. Narrowing stops at one value or at ``border_rows`` rows. ``df`` is read once a pass.
    """
    if k < 1:
        raise ValueError(f"at least one row has to be asked for, not {k}")
    cuts: dict[str, Cut] = {}
    ranges: dict[str, tuple[float, float]] = {}
    taken = dict.fromkeys(columns, 0)
    while len(cuts) < len(columns):
        open_columns = [name for name in columns if name not in cuts]
        cells = []
        for place, name in enumerate(open_columns):
            value = F.col(name)
            if name in ranges:
                low, high = ranges[name]
                step = F.floor((value - F.lit(low)) / F.lit(high - low) * (CUT_BINS - 1)).cast("int")
                step = F.when(value.between(low, high), step)
            else:
                step = _magnitude(value)
            cells.append(F.struct(F.lit(place).alias("place"), step.alias("bin"), value.alias("value")))
        counted = (
            df.select(F.explode(F.array(*cells)).alias("cell"))
            .filter("cell.bin IS NOT NULL")
            .groupBy("cell.place", "cell.bin")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("cell.value").alias("low"), F.max("cell.value").alias("high"))
            .collect()
        )
        for place, name in enumerate(open_columns):
            value = F.col(name)
            for cell in sorted((c for c in counted if c["place"] == place), key=lambda c: -c["bin"]):
                if taken[name] + cell["rows"] < k:
                    taken[name] += cell["rows"]
                    continue
                low, high, wanted = cell["low"], cell["high"], k - taken[name]
                if low is None:
                    cuts[name] = Cut(value.isNotNull(), value.isNull(), wanted, cell["rows"])
                elif low == high or low != low or cell["rows"] <= max(border_rows, wanted):
                    cuts[name] = Cut(value > high, value.between(low, high), wanted, cell["rows"])
                else:
                    ranges[name] = low, high
                break
            else:
                cuts[name] = Cut(F.lit(True), F.lit(False), 0, 0)
    return cuts


def rows_of_cut(df: DataFrame, cut: Cut, order: Sequence[Column | str]) -> DataFrame:
    """The rows of ``cut``; only those at its border are sorted by ``order`` (which must end in a unique key)."""
    border = df.filter(cut.border)
    if cut.wanted < cut.border_rows:
        border = top_rows(border, order, cut.wanted)
    return df.filter(cut.above).unionByName(border)


def exact_quantile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One-row table with the linearly interpolated quantile of ``column``; NULL when there are no values.

    Equal values are counted first, so the sort sees each distinct value once.
    """
    histogram = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    running, totals = with_running_totals(histogram, ["_value"], {"_seen": "_rows"})
    n = int(totals["_seen"])
    position = max(n - 1, 0) * q
    below = int(position)
    above = min(below + 1, max(n - 1, 0))
    low = F.min(F.when(F.col("_seen") > below, F.col("_value")))
    high = F.min(F.when(F.col("_seen") > above, F.col("_value")))
    return running.agg((low + (high - low) * F.lit(position - below)).alias(name))
