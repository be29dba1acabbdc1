"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, on DataFrame functions only.

A text's paragraphs are its lines, longer ones cut at the first blank after every ``PARAGRAPH`` characters. Each distinct
paragraph digest is added to three of the sketch's 24 cells, one in each row; a cell holds how many digests it has, their
XOR and the XOR of their checks. The fingerprint is the text of the cells in use.

Two versions are compared by subtracting cells: common paragraphs vanish. Peeling then recovers the rest: a cell with one
digest left gives it away, removing it from its other cells frees more. A digest has one cell in each row, so one row's
lone digests are all removed at once, row after row; every such step is one aggregate over cells. If cells remain, the
sketch was too small and the pair is retried with a larger one: as many segments of a few digests each as the two
versions need, then with twice and four times the cells. What is left after that (digests with equal hash bits
throughout) is the exact set difference. Work is linear in the number of paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarflow.llm.common import freeze, text_key

PARAGRAPH = 160
PIECES = rf"[^\n]{{{PARAGRAPH},}}?\x20|[^\n]+"
ROWS, WIDTH, ROUNDS = 3, 8, 4
SEGMENT_DIGESTS = 4
# Documents that meet in one window, and the most windows that an ordering is cut into.
BUCKET_DOCS, MOST_BUCKETS = 256, 10_000
FIRST = -(1 << 63)


def paragraph_digests(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _place(digest: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(width * ROWS + row)), F.lit(width)).cast("int") + row * width


def _check(digest: Column) -> Column:
    return F.hash(digest, F.lit("check"))


def _added(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Cells of ``keys, digest, sign``: ``cell, n, key, check``, with the counts of recovered digests still 0."""
    places = F.array(*(_place(F.col("digest"), row, width) for row in range(ROWS)))
    cells = rows.select(*keys, "digest", "sign", _check(F.col("digest")).alias("check"), F.explode(places).alias("cell"))
    sums = [F.sum("sign").alias("n"), F.bit_xor("digest").alias("key"), F.bit_xor("check").alias("check")]
    return cells.groupBy(*keys, "cell").agg(*sums)


def _peeled(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, lost, gained, failed``: digests only in the first and only in the second version, and whether cells remain.

    Recovered digests are counted in cell -1.
    """
    zero, nil = F.lit(0).cast("bigint"), F.lit(0)
    cells = cells.filter("n <> 0 or key <> 0 or check <> 0").withColumns({"lost": zero, "gained": zero})

    def entry(cell: Column, n: Column, key: Column, check: Column, lost: Column, gained: Column) -> Column:
        return F.struct(cell.alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"), lost.alias("lost"), gained.alias("gained"))

    own = [F.col(c) for c in ("cell", "n", "key", "check", "lost", "gained")]
    for step in range(ROUNDS * ROWS):
        row = step % ROWS
        alone = (F.col("cell") >= row * width) & (F.col("cell") < (row + 1) * width) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
        gone = [entry(_place(F.col("key"), other, width), -F.col("n"), F.col("key"), F.col("check"), zero, zero) for other in range(ROWS) if other != row]
        count = entry(F.lit(-1), zero, zero, nil, (F.col("n") == 1).cast("bigint"), (F.col("n") == -1).cast("bigint"))
        moved = cells.select(*keys, F.inline(F.when(alone, F.array(*gone, count)).otherwise(F.array(entry(*own)))))
        sums = [F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"), F.sum("lost").alias("lost"), F.sum("gained").alias("gained")]
        cells = moved.groupBy(*keys, "cell").agg(*sums).filter("cell = -1 or n <> 0 or key <> 0 or check <> 0")
    return cells.groupBy(*keys).agg(F.sum("lost").alias("lost"), F.sum("gained").alias("gained"), F.max(F.col("cell") >= 0).alias("failed"))


PAIR = ["_bucket", "_no", "pair"]
SIDES = {"edited": "edited_digests", "next": "next_digests"}


def _signed(pairs: DataFrame) -> DataFrame:
    """``PAIR, digest, sign`` of both versions' digests (``one``, ``other``)."""

    def side(name: str, sign: int) -> Column:
        return F.transform(name, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))

    rest = [c for c in pairs.columns if c not in ("one", "other")]
    return pairs.select(*rest, F.inline(F.concat(side("one", 1), side("other", -1))))


def _failed_pairs(versions: DataFrame, failed: DataFrame, both: Column) -> DataFrame:
    """The pairs to be tried again. The join leaves the rows where the aggregates need them, at every size."""
    again = failed.groupBy("_bucket", "_no").agg(F.collect_set("pair").alias("again")).hint("merge")
    pairs = versions.join(again, ["_bucket", "_no"]).select("_bucket", "_no", "again", F.inline(both))
    return pairs.filter(F.array_contains("again", F.col("pair"))).drop("again")


def compared(versions: DataFrame) -> DataFrame:
    """``_bucket, _no, pair, lost, gained`` for the pairs of every row of ``versions`` that differ at all."""
    both = F.array(*(F.struct(F.lit(name).alias("pair"), F.col("digests").alias("one"), F.col(digests).alias("other")) for name, digests in SIDES.items()))
    # All groups below lie inside one row of versions: one exchange of the rows serves every aggregate.
    row = ["_bucket", "_no"]
    pairs = versions.repartition(*row).select(*row, F.inline(both))
    found = freeze(_peeled(_added(_signed(pairs), PAIR, WIDTH), PAIR, WIDTH), "peeled")
    done = [found.filter("not failed")]
    failed = found.filter("failed").select(*PAIR)
    for attempt in range(3):
        width = WIDTH << attempt
        again = _failed_pairs(versions, failed, both)
        segments = F.ceil((F.size("one") + F.size("other")) / SEGMENT_DIGESTS).cast("bigint")
        signed = _signed(again.withColumn("segments", segments))
        dealt = signed.withColumn("segment", F.pmod(F.xxhash64("digest", F.lit("segment")), F.col("segments")))
        keys = [*PAIR, "segment"]
        parts = _peeled(_added(dealt, keys, width), keys, width)
        whole = parts.groupBy(*PAIR).agg(F.sum("lost").alias("lost"), F.sum("gained").alias("gained"), F.max("failed").alias("failed"))
        found = freeze(whole, "peeled")
        done.append(found.filter("not failed"))
        failed = found.filter("failed").select(*PAIR)
        if failed.isEmpty():
            break
    else:
        rest = _failed_pairs(versions, failed, both)
        sizes = [F.size(F.array_except(a, b)).cast("bigint").alias(name) for a, b, name in (("one", "other", "lost"), ("other", "one", "gained"))]
        done.append(rest.select(*PAIR, *sizes))
    out = done[0].select(*PAIR, "lost", "gained")
    for part in done[1:]:
        out = out.unionByName(part.select(*PAIR, "lost", "gained"))
    return out


def sketches(versions: DataFrame) -> DataFrame:
    """``_bucket, _no, fingerprint, edited_fingerprint``: the cells in use, in order, in hexadecimal."""
    both = F.array(*(F.struct(F.lit(v).alias("version"), F.col(c).alias("all")) for v, c in (("text", "digests"), ("edited", "edited_digests"))))
    keys = ["_bucket", "_no", "version"]
    one = versions.repartition("_bucket", "_no").select("_bucket", "_no", F.inline(both)).select(*keys, F.explode("all").alias("digest"), F.lit(1).alias("sign"))
    cell = F.format_string("%02x:%x:%016x:%08x", "cell", "n", "key", "check")
    written = _added(one, keys, WIDTH).groupBy("_bucket", "_no").agg(
        *(F.array_join(F.array_sort(F.collect_list(F.when(F.col("version") == v, cell))), " ").alias(name) for v, name in (("text", "fingerprint"), ("edited", "edited_fingerprint")))
    )
    return written


def likeness(size: Column, lost: Column, gained: Column) -> Column:
    """Common paragraphs over all paragraphs of both; two texts without any are alike."""
    return F.when(size + gained > 0, (size - lost) / (size + gained)).otherwise(1.0)


def _bucket(doc: Column, splits: list[int]) -> Column:
    """Number of splits up to ``doc``: first among every so many splits, then among those in between."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    array = lambda values: F.array(*map(F.lit, values))
    coarse = F.size(F.filter(array(splits[::step]), lambda s: s <= doc))
    fine = F.slice(array(splits), F.greatest((coarse - 1) * step + 1, F.lit(1)), F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda s: s <= doc)))


def with_next(docs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``docs`` (with ``_doc`` and a tie breaker ``_t1, _t2``) and ``next_<column>`` of the following row, ``_doc``
    descending; after the last comes the first. ``_bucket, _no`` name a row.

    The order is cut into buckets by approximate quantiles of ``_doc``; the greatest row of each bucket is sent to the
    bucket above as well, so the neighbour across a border is at hand and no window spans more than a bucket.
    """
    spark = docs.sparkSession
    count = docs.count()
    wanted = min(MOST_BUCKETS, -(-count // BUCKET_DOCS))
    quantiles = [i / wanted for i in range(1, wanted)]
    splits = sorted(set(docs.agg(F.percentile_approx("_doc", quantiles, 10 * MOST_BUCKETS)).first()[0] or [])) if quantiles else []
    placed = docs.withColumn("_bucket", _bucket(F.col("_doc"), splits))
    tops = sorted((row["_bucket"], row["top"]) for row in placed.groupBy("_bucket").agg(F.max("_doc").alias("top")).collect())  # one row per bucket
    guests = [(tops[i][1], tops[i + 1][0], False) for i in range(len(tops) - 1)]
    if tops:
        guests.append((tops[-1][1], tops[0][0], True))
    visits = spark.createDataFrame(guests, "_doc bigint, _bucket int, _wrap boolean").groupBy("_doc").agg(
        F.collect_list(F.struct("_bucket", "_wrap", F.lit(True).alias("_guest"))).alias("_visits")
    )
    home = F.array(F.struct("_bucket", F.lit(False).alias("_wrap"), F.lit(False).alias("_guest")))
    stays = F.concat(home, F.coalesce("_visits", F.array().cast("array<struct<_bucket:int,_wrap:boolean,_guest:boolean>>")))
    spread = placed.join(F.broadcast(visits), "_doc", "left").withColumn("_stay", F.explode(stays)).select(*docs.columns, "_stay.*")
    order = Window.partitionBy("_bucket").orderBy("_wrap", F.desc("_doc"), "_t1", "_t2")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return spread.select("*", F.row_number().over(order).alias("_no"), *following).filter("not _guest").drop("_wrap", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see ``edited_versions`` for the edit.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. NULL counts as
    the empty text, whose sketch is empty; two empty texts are alike. A NULL doc_id comes last in the order. Rows that
    repeat a doc_id follow each other by text; equal rows are alike. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("_doc"), text.alias("text"), *text_key(F.col("text").cast("string")))
    rows = with_next(rows.withColumn("digests", paragraph_digests(F.col("text"))), ["text", "digests"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("_bucket", "_no", "doc_id", F.length("text").cast("bigint").alias("n_chars"), "digests", "next_digests", edited.alias("edited"))
    rows = rows.select(
        "_bucket", "_no", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", "next_digests", paragraph_digests(F.col("edited")).alias("edited_digests")
    )
    rows = freeze(rows, "versions")
    found = compared(rows).groupBy("_bucket", "_no").agg(
        *(F.sum(F.when(F.col("pair") == pair, F.col(c))).alias(f"{c}_{pair}") for pair in SIDES for c in ("lost", "gained"))
    )
    out = rows.join(freeze(sketches(rows), "sketches"), ["_bucket", "_no"], "left").join(freeze(found, "differences"), ["_bucket", "_no"], "left")
    near = [likeness(F.size("digests"), *(F.coalesce(f"{c}_{pair}", F.lit(0)) for c in ("lost", "gained"))).alias(f"near_{pair}") for pair in SIDES]
    prints = [F.coalesce(c, F.lit("")).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", *prints, *near)
