"""Line dedup by a deletion-neighbourhood join, on DataFrame functions only.

Lines are compared without blanks at their ends, in lower case if ``fold_case`` is set. A line goes if an earlier line (by doc_id, then line
number) is within one edit: equal, one character replaced, or one character more or less. Lines under ``MIN_CHARS``
characters take no part: short lines are equal by chance.

Two lines are within one edit if they are equal after removing one character at the same place of both, or one
character of the longer one. Emitting every such variant of every line would take as many rows as the corpus has
characters, so it is done in steps. Lines whose both ends are their own have no neighbour. Of the others whole blocks are
removed: a line is cut into blocks of up to ``BLOCK`` characters, and what is left without one block is hashed with the
block's number and the line's length; a line also emits the keys it would have if it were one character shorter. Lines
within one edit share a key, since the edit lies in one block. Only under keys that different lines share are the
variants of the removed block itself emitted, one per removed character. Lines with equal variants are joined through the
group's earliest line, and the pair's edit distance is verified on the block texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import attach, freeze, text_key

MIN_CHARS, BLOCK, MOST_BLOCKS, ENDS = 20, 64, 256, 32
LAST = (1 << 63) - 1
BLANKS = " \t\r"


def normalized(line: Column, fold_case: bool = False) -> Column:
    blank = reduce(lambda a, b: a | b, (end(c) for end in (line.startswith, line.endswith) for c in BLANKS))
    # Trimming looks at every character, its condition at the two ends.
    trimmed = F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line)
    return F.lower(trimmed) if fold_case else trimmed


def _lines(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """Long enough lines: document and text key, number, ``pos`` (order of doc_id, then number), 128-bit hash."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), *text_key(F.col("text")), "text")
    # Normalized inside the list: a column on top of it would be evaluated once more for the filter on its length.
    split = F.transform(F.split("text", "\n", -1), lambda line: normalized(line, fold_case))
    lines = keyed.select("_doc", "_t1", "_t2", F.posexplode(split).alias("line_no", "line")).filter(F.length("line") >= MIN_CHARS)
    # One number instead of a struct: its minimum is kept in a hash aggregate.
    pos = F.col("_doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    return lines.select(
        "_doc", "_t1", "_t2", "line_no", pos.cast("decimal(32,0)").alias("pos"), "line", F.length("line").alias("chars"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
    )


def _block_size(length: Column) -> Column:
    """Characters of a block: two blocks at least, ``MOST_BLOCKS`` at most."""
    return F.greatest(F.least(F.lit(BLOCK), F.ceil(length / 2)), F.ceil(length / MOST_BLOCKS)).cast("string")


def _prefixes(pieces: Column) -> Column:
    """Combined hash of the first 0, 1, 2, ... pieces, each hashed with its number."""
    hashes = F.transform(pieces, lambda piece, i: F.xxhash64(i, piece))
    return F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda done, h: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(h))))


def _keyed(lines: DataFrame) -> DataFrame:
    """Keys of each line without each block: of the line as it is, then as if it had one character less (``longer``).

    A line is cut in one go; every block is hashed once with its number, and a key combines the hashes of the others. In
    the ``longer`` view the blocks behind the one left out begin one character later: they are cut from the line's second
    character on.
    """
    views = F.array(
        F.struct(F.lit(False).alias("longer"), F.col("chars").alias("length")),
        F.struct(F.lit(True).alias("longer"), (F.col("chars") - 1).alias("length")),
    )
    viewed = lines.select("pos", "h1", "h2", "line", F.inline(views))
    cut = F.concat(F.lit("(?s).{1,"), _block_size(F.col("length")), F.lit("}"))
    pieces = lambda first: F.regexp_extract_all(F.substring("line", first, F.col("length")), cut, F.lit(0))
    late = F.when(F.col("longer"), F.lit(2)).otherwise(F.lit(1))
    both = viewed.select("pos", "h1", "h2", "longer", "length", pieces(F.lit(1)).alias("before"), pieces(late).alias("after"))
    summed = both.select("pos", "h1", "h2", "longer", "length", _prefixes(F.col("before")).alias("front"), _prefixes(F.col("after")).alias("back"), F.arrays_zip("before", "after").alias("blocks"))
    each = summed.select("pos", "h1", "h2", "longer", "length", "front", "back", F.posexplode("blocks").alias("number", "piece"))
    rest = F.get("front", "number").bitwiseXOR(F.element_at("back", -1)).bitwiseXOR(F.get("back", F.col("number") + 1))
    block = F.when(F.col("longer"), F.concat("piece.before", F.right("piece.after", F.lit(1)))).otherwise(F.col("piece.before"))
    return each.select("pos", "h1", "h2", F.xxhash64("length", "number", rest).alias("key"), "longer", block.alias("block"))


def _variants(members: DataFrame) -> DataFrame:
    """``key, kind, place, variant``: kind 0 has the character at ``place`` removed on both sides, kind 1 on one side.

    A line as it is emits its block without each character, and the whole block to meet those that are longer; a longer
    one its block without each character.
    """
    first = F.when(F.col("longer"), 0).otherwise(-1)
    last = F.length("block") - 1
    spread = members.select("key", "longer", "h1", "h2", "pos", "block", F.explode(F.when(last >= first, F.sequence(first, last))).alias("at"))
    without = F.concat(F.substring("block", F.lit(1), F.col("at")), F.substring("block", F.col("at") + 2, F.length("block")))
    text = F.when(F.col("at") < 0, F.col("block")).otherwise(without)
    one_sided = F.col("longer") | (F.col("at") < 0)
    return spread.select(
        "key", "longer", "h1", "h2", "pos", one_sided.cast("int").alias("kind"), F.when(one_sided, -1).otherwise(F.col("at")).alias("place"), F.xxhash64(text).alias("variant")
    )


def _probes(lines: DataFrame) -> DataFrame:
    """Keys by which a line meets equal lines (``near`` false) and lines that may be within one edit (``near`` true).

    The edit is in one half of the line, so ``ENDS`` characters of the other end, or half of a shorter line, are equal.
    A short line also probes as if it had one character less.
    """
    half = lambda length: F.least(F.lit(ENDS), F.floor(length / 2).cast("int"))
    own, less = half(F.col("chars")), half(F.col("chars") - 1)

    def ends(size: Column) -> list[Column]:
        parts = (F.substring("line", F.lit(1), size), F.substring("line", F.col("chars") - size + 1, size))
        return [F.struct(F.lit(True).alias("near"), F.xxhash64(F.lit(i), part).alias("k1"), F.lit(0).cast("bigint").alias("k2")) for i, part in enumerate(parts)]

    equal = F.struct(F.lit(False).alias("near"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    short = F.array(equal, *ends(own), *ends(less))
    return lines.select("pos", "h1", "h2", "line", "chars", "_doc", "_t1", "_t2", "line_no", F.inline(F.when(own == less, F.array(equal, *ends(own))).otherwise(short)))


def _later_near_lines(lines: DataFrame) -> DataFrame:
    """``h1, h2`` of distinct lines that have an earlier line at distance one."""
    # Cutting long lines is the dear part: done once, and written.
    keyed = freeze(_keyed(lines), "line-keyed")
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key")
    found = attach(keyed, freeze(shared, "line-keys"), "key")
    members = freeze(found.groupBy("key", "longer", "h1", "h2").agg(F.min("pos").alias("pos"), F.min("block").alias("block")), "line-members")
    # A line removed on one side meets only lines that are whole, and the other way round.
    variants = freeze(_variants(members).withColumn("side", (F.col("kind") == 1) & F.col("longer")), "line-variants")
    met = ["key", "kind", "place", "variant"]
    first = variants.groupBy(*met, "side").agg(F.min("pos").alias("its_pos"))
    other = first.withColumn("side", F.when(F.col("kind") == 1, ~F.col("side")).otherwise(F.col("side")))
    pairs = variants.join(other, [*met, "side"]).filter("its_pos < pos").groupBy("key", "h1", "h2").agg(F.min("its_pos").alias("its_pos"))
    mine = members.select("key", "h1", "h2", "block").dropDuplicates(["key", "h1", "h2"])
    its = members.select("key", F.col("pos").alias("its_pos"), F.col("block").alias("its_block")).dropDuplicates(["key", "its_pos"])
    both = freeze(pairs, "line-pairs").join(mine, ["key", "h1", "h2"]).join(its, ["key", "its_pos"])
    return both.filter(F.levenshtein("block", "its_block", 1) >= 0).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """``_doc, _t1, _t2, removed``: the numbers (from 0) of the lines that go, for documents that lose any.

    The documents are read twice: to count the keys, and to fetch the lines whose keys are shared. All else works on these.
    """
    probes = _probes(_lines(docs, fold_case))
    counted = probes.groupBy("near", "k1", "k2").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("h1").alias("low"), F.max("h1").alias("high")
    )
    met = freeze(counted.filter((F.col("near") & (F.col("low") != F.col("high"))) | (~F.col("near") & (F.col("rows") > 1))).select("near", "k1", "k2", "first"), "line-probes")
    # The line itself is needed only where it may have a neighbour.
    fetched = attach(probes, met, ["near", "k1", "k2"]).withColumn("line", F.when(F.col("near"), F.col("line")))
    fetched = freeze(fetched.select("_doc", "_t1", "_t2", "line_no", "pos", "h1", "h2", "near", "first", "line", "chars"), "lines")
    # A line stands here once for each of its keys.
    candidates = fetched.filter("near").groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.min("line").alias("line"), F.min("chars").alias("chars"))
    late = freeze(_later_near_lines(candidates), "line-near")
    copies = fetched.filter("not near and pos > first").select("_doc", "_t1", "_t2", "line_no")
    near = attach(fetched.filter("near").select("_doc", "_t1", "_t2", "line_no", "h1", "h2"), late, ["h1", "h2"]).drop("h1", "h2")
    return copies.unionByName(near).groupBy("_doc", "_t1", "_t2").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def line_dedup(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """All columns of ``docs`` with the lines removed from ``text``, and ``n_lines``, ``removed`` (numbers from 0).

    Texts that lose nothing stay as they are, NULL included (0 lines; an empty text has one empty line). Rows with a
    NULL doc_id come last in the order. Rows that repeat doc_id and text are one document and lose the same lines.
    Columns named ``n_lines`` or ``removed`` are replaced, other columns pass through. With ``fold_case`` lines that
    differ in the case of letters only are equal; the text that is kept keeps its case.
    """
    docs = docs.drop("n_lines", "removed")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = freeze(removed_lines(plain, fold_case), "line-cuts")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("_doc"), *text_key(F.col("text").cast("string")))
    # The lists follow the corpus: both sides are shuffled at every size.
    joined = keyed.join(cuts.hint("merge"), ["_doc", "_t1", "_t2"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    names = [F.when(F.col("removed").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<int>")
    return joined.select(*names, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce("removed", none).alias("removed"))
