"""Merkle manifest of a dataset, with an audit of every leaf by a recursive query.

A leaf is the SHA-256 of a row's named fields. The leaves of a group, in order, form a binary tree (a last node without
partner is hashed alone); the groups' roots, in the order of their names, form another one on top.

Levels are built ``SPAN`` at a time: one block of up to 1,024 neighbours per group and position. What is stored of them is
one row per node at every ``SPAN``-th level, linked to its parent of the next stored level and carrying the siblings on
the way there; the root of a group carries the way through the upper tree. An audit climbs these links in a recursive
query: each leaf starts with its (possibly tampered) hash, takes the parent's row at every step, appends the siblings it
meets and folds its hash with them.

A stored node is met by all leaves below it. From the second stored level on it is therefore kept once per ``CELL``
leaves, and a leaf asks for the copy of its own cell: no key of the climb is met by more than ``CELL`` rows, and the
copies are one row per ``CELL`` leaves and level.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.scale import rank_within, with_ordinal
from bazaarflow.llm.common import freeze

SPAN = 10
CELL_BITS = 12  # between SPAN and twice SPAN
CELL = 1 << CELL_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before: binary, after: binary>"
ABOVE = 1 << 20  # stored level of a root of all


def field_hash(values: list[Column]) -> Column:
    """Binary SHA-256 of the values: ``-`` for NULL, else the number of UTF-8 bytes, a colon, the value."""
    texts = [value.cast("string") for value in values]
    parts = [F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)) for text in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(before: Column, own: Column, after: Column) -> Column:
    """Hash of neighbours, in order; a missing one is left out."""
    parts = [F.coalesce(hex_text(part), F.lit("")) for part in (before, own, after)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _folded(own: Column, steps: Column) -> Column:
    return F.aggregate(steps, own, lambda digest, step: _joined(step["before"], digest, step["after"]))


def _siblings(steps: Column) -> Column:
    nothing = F.lit("").cast("binary")
    return F.aggregate(steps, nothing, lambda done, step: F.concat(done, F.coalesce(step["before"], step["after"], nothing)))


def height(count: Column) -> Column:
    """Levels above the leaves of a tree of ``count`` leaves."""
    return F.when(count > 1, F.length(F.bin(count - 1))).otherwise(0)


def _climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One stored level up. ``nodes`` (tree, leaves, depth, pos, digest) get ``steps``, the siblings up to their parent;
    the second table holds the parents. At most 1,024 nodes meet in one group."""
    blocks = nodes.groupBy("tree", "leaves", "depth", F.shiftright("pos", SPAN).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("members")
    )
    rise = F.least(F.lit(SPAN), height(F.col("leaves")) - F.lit(SPAN) * F.col("depth"))
    above = lambda row: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int")),
        lambda i: _joined(F.lit(None).cast("binary"), F.get(row, 2 * i), F.get(row, 2 * i + 1)),
    )
    first = F.array(F.transform("members", lambda m: m["digest"]))
    levels = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(SPAN)), F.lit(1), rise), first, lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    built = freeze(blocks.select("tree", "leaves", "depth", "block", "members", levels.alias("levels")), "merkle-blocks")
    parents = built.select("tree", "leaves", (F.col("depth") + 1).alias("depth"), F.col("block").alias("pos"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))

    def way(place: Column) -> Column:
        """The siblings of the node at ``place``, level by level."""
        at = lambda k: F.call_function("shiftright", place, k)
        row = lambda k: F.get(F.col("levels"), k)
        return F.transform(
            F.sequence(F.lit(0), F.size("levels") - 2),
            lambda k: F.struct(F.when(at(k) % 2 == 1, F.get(row(k), at(k) - 1)).alias("before"), F.when(at(k) % 2 == 0, F.get(row(k), at(k) + 1)).alias("after")),
        )

    # A tree of one leaf has no step and is not built, so there are two levels at least.
    placed = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest"), way(i).alias("steps"), m["payload"].alias("payload")))
    return built.select("tree", "leaves", "depth", F.inline(placed)), parents


def _stored(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Stored nodes below the roots, a frozen table per stored level, and the roots: ``tree, leaves, depth, digest``.

    ``leaves``: ``tree, leaves, pos, digest`` and the columns of ``payload``, which stay with the lowest level.
    """
    tops = leaves.filter(height(F.col("leaves")) == 0).select("tree", "leaves", F.lit(0).alias("depth"), "digest")
    current = leaves.withColumn("depth", F.lit(0)).withColumn("payload", F.struct(*payload))
    most = leaves.agg(F.max(height(F.col("leaves")))).first()[0] or 0
    levels = []
    for depth in range(max(1, math.ceil(most / SPAN))):
        nodes, parents = _climbed(current.filter(height(F.col("leaves")) > SPAN * depth))
        levels.append(nodes)
        done = height(F.col("leaves")) <= SPAN * (depth + 1)
        tops = tops.unionByName(parents.filter(done).select("tree", "leaves", "depth", "digest"))
        current = parents.withColumn("payload", F.lit(None).cast(nodes.schema["payload"].dataType))
    return levels, tops


def _ways_to_the_top(roots: DataFrame) -> DataFrame:
    """``tree, leaves, depth, subroot, steps, root``: the way of every group's root through the upper tree."""
    placed, count = with_ordinal(roots, ["tree"], "pos")
    upper = placed.select(F.lit("").alias("tree"), F.lit(count).cast("bigint").alias("leaves"), "pos", "digest", F.col("tree").alias("group"), F.col("leaves").alias("below"), F.col("depth").alias("at"))
    levels, tops = _stored(upper, ["group", "below", "at"])
    way = levels[0].select("pos", "digest", "steps", "payload.*")
    if count == 1:
        way = upper.select("pos", "digest", F.array().cast(f"array<{STEP}>").alias("steps"), "group", "below", "at")
    for depth, level in enumerate(levels[1:], 1):
        above = level.select(F.col("pos").alias("_pos"), F.col("steps").alias("_steps"))
        way = way.join(above, F.shiftright("pos", SPAN * depth) == F.col("_pos")).withColumn("steps", F.concat("steps", "_steps")).drop("_pos", "_steps")
    top = tops.first()  # the root of all; none if there are no rows
    root = F.lit(None if top is None else bytearray(top["digest"])).cast("binary")
    return way.select(F.col("group").alias("tree"), F.col("below").alias("leaves"), F.col("at").alias("depth"), F.col("digest").alias("subroot"), "steps", root.alias("root"))


def _linked(levels: list[DataFrame], ways: DataFrame) -> DataFrame:
    """Node rows as the climb asks for them: ``tree, depth, slot, parent_depth, steps, subroot, root``."""
    nothing = F.lit(None).cast("binary")
    below = [
        level.select("tree", "leaves", "depth", "pos", "steps", (F.col("depth") + 1).alias("parent_depth"), nothing.alias("subroot"), nothing.alias("root"))
        for level in levels[1:]
    ]
    rows = ways.select("tree", "leaves", "depth", F.lit(0).cast("bigint").alias("pos"), "steps", F.lit(ABOVE).alias("parent_depth"), "subroot", "root")
    for level in below:
        rows = rows.unionByName(level)
    # Shift that leads from a node to its cells; a node of the two lowest levels is one slot.
    shift = F.greatest(F.lit(0), F.lit(SPAN) * F.col("depth") - CELL_BITS)
    last = F.least(F.call_function("shiftleft", F.col("pos") + 1, shift), F.shiftright(F.col("leaves") + (CELL - 1), CELL_BITS)) - 1
    slots = F.when(F.col("depth") < 2, F.array("pos")).otherwise(F.sequence(F.call_function("shiftleft", F.col("pos"), shift), last))
    return rows.select("tree", "depth", F.explode(slots).alias("slot"), "parent_depth", "steps", "subroot", "root")


def _climb_sql(start: str, nodes: str) -> str:
    neighbours = "concat(coalesce(lower(hex(step.before)), ''), lower(hex(digest)), coalesce(lower(hex(step.after)), ''))"
    return f"""
WITH RECURSIVE climb AS (
  SELECT tree, pos, doc_id, leaf, depth, proof, folded, CAST(NULL AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root FROM {start}
  UNION ALL
  SELECT /*+ MERGE(n) */ c.tree, c.pos, c.doc_id, c.leaf, n.parent_depth AS depth,
    concat(c.proof, aggregate(n.steps, CAST('' AS BINARY), (done, step) -> concat(done, coalesce(step.before, step.after, CAST('' AS BINARY))))) AS proof,
    aggregate(n.steps, c.folded, (digest, step) -> unhex(sha2({neighbours}, 256))) AS folded, n.subroot, n.root
  FROM climb c JOIN {nodes} n
    ON n.tree = c.tree AND n.depth = c.depth AND n.slot = shiftright(c.pos, least({SPAN} * c.depth, {CELL_BITS}))
  WHERE c.depth < {ABOVE}
)
SELECT doc_id, leaf, subroot, root, proof, folded FROM climb WHERE depth = {ABOVE}"""


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", changed: str = "n_chars") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded`` (binary digests; ``proof``: the siblings of the way up, joined)
    of every row of ``docs``.

    ``fields`` are hashed in their order. Where ``tampered`` holds, the audited row has one more in column ``changed``,
    unless that is NULL; ``folded`` is the root that follows from the audited row. A NULL ``group`` is a group of its own
    and the first; inside a group a NULL doc_id comes first and rows of equal doc_id are ordered by their hash, so that
    equal rows are leaves of their own. Texts of every length are hashed whole. Other columns are ignored; an empty table
    gives an empty manifest.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{name}`") for name in fields]
    more = [F.col(f"`{name}`").cast("decimal(20,0)") + 1 if name == changed else F.col(f"`{name}`") for name in fields]
    audited = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    audited = audited & F.col(f"`{changed}`").isNotNull()
    hashed = docs.select(
        F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        field_hash(own).alias("leaf"),
        F.when(audited, field_hash(more)).alias("altered"),
    )
    hashed = freeze(hashed, "merkle-leaves")
    counts = hashed.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
    ranked = rank_within(hashed, "tree", ["doc_id", "leaf"], "rank").select("tree", (F.col("rank") - 1).alias("pos"), "doc_id", F.col("leaf").alias("digest"), "altered")
    # One row per group; a group may hold most rows, so adaptive execution splits it where it is not copied.
    leaves = freeze(ranked.join(counts, "tree"), "merkle-ranked")
    levels, roots = _stored(leaves, ["doc_id", "altered"])
    ways = freeze(_ways_to_the_top(freeze(roots, "merkle-roots")), "merkle-ways")
    nodes = freeze(_linked(levels, ways), "merkle-nodes")
    single = leaves.filter("leaves = 1").select("tree", "leaves", F.lit(0).alias("depth"), "pos", "digest", F.array().cast(f"array<{STEP}>").alias("steps"), F.struct("doc_id", "altered").alias("payload"))
    first = levels[0].unionByName(single)
    start = first.select(
        "tree", "pos", "payload.doc_id", F.col("digest").alias("leaf"), (height(F.col("leaves")) > 0).cast("int").alias("depth"),
        _siblings(F.col("steps")).alias("proof"), _folded(F.coalesce("payload.altered", "digest"), F.col("steps")).alias("folded"),
    )
    names = [f"merkle_{kind}_{uuid4().hex}" for kind in ("start", "nodes")]
    start.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # every leaf is a row at every step
    try:
        return freeze(spark.sql(_climb_sql(*names)), "merkle-climb")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
        for name in names:
            spark.catalog.dropTempView(name)
