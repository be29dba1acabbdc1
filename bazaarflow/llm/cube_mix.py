"""Mixing sources to target weights by the cube method of balanced sampling.

A source that should give ``r`` times its size takes every document ``floor(r)`` times and draws the rest: each of its
documents enters once more with probability ``r - floor(r)``. The draw is balanced on two totals, words and documents.
The flight moves the fractional probabilities of three documents along a direction that changes neither total, up or
down at random so that every document keeps its probability, until one of the three is 0 or 1; then the next document
takes its place. At most two documents of a group stay undecided.

A source is flown in groups of about ``GROUP`` documents, spread over all tasks; the undecided of all groups form the
groups of the next round, so each round shrinks the problem by a factor of hundreds, until one small landing problem
per source remains. It is landed by giving up the document total first and then rounding the last document. Long
documents are flown first, so that what is rounded at the end is short. All draws are hashes of the ids: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.functions.scale import with_ordinal, with_running_totals
from bazaarflow.llm.common import BROADCAST_ROWS, WORD, freeze

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, MOST = 1.5, 2.0
GROUP = 1_000
EDGE = 1e-9
HEAVY = 0.02


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Weights repeat along the sources by code point, NULL last. A source is capped at ``MOST`` times its size. The capped
    ones are a prefix in the order of cap per weight: one source is capped if what is left after all caps before it,
    shared over the weights from it on, exceeds its cap. Ranks and running totals are distributed sorts.
    """
    placed, _ = with_ordinal(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighted = placed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / weight)
    whole = weighted.withColumn("w", F.col("weight").cast("bigint"))
    running, totals = with_running_totals(whole, ["ratio", "place"], {"sizes": "source_size", "weights": "w"})
    budget = BUDGET * float(totals["sizes"] or 0)
    before = F.col("sizes") - F.col("source_size")
    share = (F.lit(budget) - MOST * before) / (F.lit(float(totals["weights"] or 1)) - F.col("weights") + F.col("w"))
    judged = freeze(running.withColumn("capped", MOST * F.col("source_size") <= F.col("weight") * share), "sources")
    rest = judged.agg(
        F.sum(F.when(F.col("capped"), F.col("source_size"))).alias("taken"), F.sum(F.when(~F.col("capped"), F.col("w"))).alias("open")
    ).first()
    level = (budget - MOST * float(rest.taken or 0)) / float(rest.open or 1)
    target = F.when(F.col("capped"), MOST * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return judged.select("source", F.col("place").alias("source_no"), "source_size", target.cast("double").alias("target"))


def _chance(seed: int) -> float:
    x = (seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return (x >> 11) / float(1 << 53)


def _move(chances: list[float], direction: tuple[float, ...], random: float) -> list[float]:
    """Go as far as the cube allows one way or the other along ``direction``; the mean of both ends is the start."""
    ahead = min((1 - p if u > 0 else p) / abs(u) for p, u in zip(chances, direction, strict=True) if u)
    back = min((p if u > 0 else 1 - p) / abs(u) for p, u in zip(chances, direction, strict=True) if u)
    length = ahead if random * (ahead + back) < back else -back
    moved = [p + length * u for p, u in zip(chances, direction, strict=True)]
    return [0.0 if p < EDGE else 1.0 if p > 1 - EDGE else p for p in moved]


def _settle_heavy(sizes: np.ndarray, chances: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Settle documents that hold more than ``HEAVY`` of the group's undecided words, so that none is left to be rounded.

    The direction is the heavy document's axis projected on the null space of both totals: the others share the change.
    """
    while True:
        open_ = np.flatnonzero((chances > EDGE) & (chances < 1 - EDGE))
        if len(open_) <= 3:
            return chances
        heavy = open_[np.argmax(sizes[open_])]
        if sizes[heavy] <= HEAVY * sizes[open_].sum():
            return chances
        totals = np.stack((np.ones(len(open_)), sizes[open_] / sizes[heavy]))
        axis = (open_ == heavy).astype(float)
        direction = axis - totals.T @ np.linalg.lstsq(totals.T, axis, rcond=None)[0]
        top = np.abs(direction).max()
        if top < 1e-6:
            return chances
        direction = np.where(np.abs(direction) < 1e-9 * top, 0.0, direction / top)
        chances[open_] = _move(chances[open_].tolist(), tuple(direction), _chance(int(seeds[heavy]) ^ len(open_)))


def fly(sizes: np.ndarray, chances: np.ndarray, seeds: np.ndarray, land: bool) -> np.ndarray:
    """Move ``chances`` to 0 or 1 while the sums of chance and of chance times size stay; at most two stay between.

    With ``land`` these two are settled as well: first on the sum of sizes alone, then the last one by its chance.
    """
    chances = _settle_heavy(sizes.astype(float), chances.astype(float).copy(), seeds)
    pool: list[int] = []
    for i in np.flatnonzero((chances > EDGE) & (chances < 1 - EDGE)):
        pool.append(int(i))
        if len(pool) < 3:
            continue
        a, b, c = (float(sizes[j]) for j in pool)
        direction = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        top = max(map(abs, direction))
        moved = _move([chances[j] for j in pool], tuple(d / top for d in direction), _chance(int(seeds[i])))
        chances[pool] = moved
        pool = [j for j in pool if 0 < chances[j] < 1]
    if land:
        if len(pool) == 2:
            a, b = (float(sizes[j]) for j in pool)
            top = max(a, b)
            direction = (b / top, -a / top) if top and min(a, b) else (1.0, -1.0)
            chances[pool] = _move([chances[j] for j in pool], direction, _chance(int(seeds[pool[1]]) ^ 0x5A5A))
            pool = [j for j in pool if 0 < chances[j] < 1]
        for j in pool:
            chances[j] = float(_chance(int(seeds[j]) ^ 0xA5A5) < chances[j])
    return chances


def _round(rows: DataFrame, groups: DataFrame, number: int, land: bool) -> DataFrame:
    """Fly every source in hashed groups. ``groups``: source_no and how many groups it is dealt into."""
    dealt = rows.join(F.broadcast(groups), "source_no")
    group = F.pmod(F.xxhash64("row_key", F.lit(number)), F.col("groups"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "row_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        seeds = part["row_key"].to_numpy() ^ number
        part["chance"] = fly(part["size"].to_numpy(), part["chance"].to_numpy(), seeds, land)
        return part.drop(columns="dealt")

    schema = "source_no bigint, row_key bigint, size bigint, chance double"
    return dealt.select("source_no", "row_key", "size", "chance", group.alias("dealt")).groupBy("source_no", "dealt").applyInPandas(run, schema)


def balanced_draw(rows: DataFrame) -> DataFrame:
    """``row_key, extra`` (0 or 1) from ``source_no, row_key, size, chance``: balanced inside each source.

    The number of groups per source is one row per source, counted before it is copied to the executors.
    """
    settled, number = [], 0
    current = rows
    while True:
        counts = current.groupBy("source_no").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        counts = freeze(counts, "groups")
        if counts.count() > BROADCAST_ROWS:
            raise ValueError("more sources than the group table allows")
        most = counts.agg(F.max("groups")).first()[0] or 0
        land = most <= 1
        flown = freeze(_round(current, counts, number, land), "flown")
        between = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.filter(~between))
        if land:
            break
        current, number = flown.filter(between), number + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select("row_key", F.col("chance").cast("int").alias("extra"))


def row_identity() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs`` (doc_id, text, source).

    ``size`` counts words; NULL and blank texts have size 0 and take nothing whatever their copies. A NULL source is one
    source, the last. Rows that repeat a doc_id are drawn each on its own; rows equal in id, text and source are told
    apart by their number among themselves. Sources of size 0 have target 0 and no copies. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        row_identity().alias("equal_key"),
    )
    same = Window.partitionBy("equal_key").orderBy("doc_id")
    rows = freeze(rows, "sizes")
    repeated = freeze(rows.groupBy("equal_key").count().filter("count > 1").select("equal_key"), "repeated")
    if not repeated.isEmpty():
        # Only rows that are equal in every respect share a window.
        rows = freeze(rows.withColumn("copy_no", F.row_number().over(same)), "numbered")
    else:
        rows = rows.withColumn("copy_no", F.lit(1))
    rows = rows.withColumn("row_key", F.xxhash64("equal_key", "copy_no"))
    targets = freeze(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(0.0)
    small = targets.count() <= BROADCAST_ROWS
    known = (F.broadcast(targets) if small else targets).withColumn("ratio", ratio).withColumnRenamed("source", "its_source")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    placed = freeze(placed.withColumn("whole", F.floor("ratio")).withColumn("chance", F.col("ratio") - F.floor("ratio")), "placed")
    draw = balanced_draw(placed.filter("size > 0").select("source_no", "row_key", "size", "chance"))
    out = placed.join(draw, "row_key", "left")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), "equal_key"
    )
