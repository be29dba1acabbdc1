"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document's set holds the hashes of its distinct five-word shingles. Each of 128 buckets keeps the smallest value of
its own permutation as a 16-bit register: the number of leading zeros (6 bits) and the next 10 bits. 32 bands of four
registers propose pairs; at the linking bound of 0.75 a pair is missed with probability (1 - 0.75**4)**32 = 5e-6. Every
link that counts is confirmed on the two full sets.

No group is ever turned into all of its pairs. Equal texts meet first and stand for one class. A document is compared
with the smallest document of all its bands; bands that still hold several components afterwards are compared further,
in blocks of bounded size, where the registers' estimate rejects most pairs, full sets decide the others, and only links
that join components are emitted. Pairs inside a component need no comparison, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import U64, attach, components, freeze, gram_hashes, map_text, mix, word_hashes

BUCKETS, BAND_ROWS = 128, 4
BANDS = BUCKETS // BAND_ROWS
MANTISSA_BITS = 10
SHINGLE_WORDS = 5
# Members of a band compared by one task; larger bands are dealt out as pairs of such blocks.
BLOCK = 256
# Standard errors below the bound at which the estimate rejects a pair.
SLACK = 5.0


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than five words has one shingle, all of its words."""
    words, offsets = word_hashes(texts, lower=True)
    grams = gram_hashes(words, SHINGLE_WORDS)
    sets = []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        if high - low >= SHINGLE_WORDS:
            sets.append(np.unique(grams[low : high - SHINGLE_WORDS + 1]))
        elif high > low:
            sets.append(gram_hashes(words[low:high], high - low) ^ U64(high - low))
        else:
            sets.append(np.empty(0, U64))
    return sets


def compress(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and the ten bits behind the leading one, in 16 bits."""
    _, exponent = np.frexp((minima >> U64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 63).astype(U64)
    shifted = np.where(zeros < 63, minima << np.minimum(zeros + U64(1), U64(63)), U64(0))
    return ((zeros << U64(MANTISSA_BITS)) | (shifted >> U64(64 - MANTISSA_BITS))).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers per (non-empty) set."""
    values = np.concatenate(sets)
    bounds = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), BUCKETS), np.uint16)
    multipliers = mix(np.arange(1, BUCKETS + 1, dtype=U64)) | U64(1)
    buffer = np.empty_like(values)
    for bucket, multiplier in enumerate(multipliers):
        np.multiply(values, multiplier, out=buffer)
        np.bitwise_xor(buffer, buffer >> U64(32), out=buffer)
        np.multiply(buffer, multiplier, out=buffer)
        out[:, bucket] = compress(np.minimum.reduceat(buffer, bounds))
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two different minima of sets of n and m elements fall into one register value.

    A register value covers a 2**-10 part of its octave, so the chance is the integral of both minima's densities over
    equal cells: n m / ((n + m)**2 * 2 ln 2 * 2**10).
    """
    return n * m / ((n + m) ** 2 * 2 * np.log(2) * 2**MANTISSA_BITS)


def estimate(equal_share: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, corrected for collisions."""
    chance = collision_rate(n, m)
    return (equal_share - chance) / (1 - chance)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its four registers mixed with the band's number."""
    packed = np.ascontiguousarray(rows).view(U64)
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=U64)))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, w1, w2, registers, bands``; w1 and w2 identify the lower-cased word sequence."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        sets = shingle_sets(texts)
        sizes = np.array([len(s) for s in sets], np.int64)
        words, offsets = word_hashes(texts, lower=True)
        lengths = np.diff(offsets).astype(U64)
        # Two independent hashes of the whole word sequence.
        whole = []
        for salt in (U64(1), U64(2)):
            placed = mix(words ^ salt) * mix(np.arange(len(words), dtype=U64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(U64) + salt)
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(placed, dtype=U64)))
            whole.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + lengths).view(np.int64))
        some = np.flatnonzero(sizes)
        regs = np.zeros((len(sets), BUCKETS), np.uint16)
        keys = np.empty((0, BANDS), U64)
        if len(some):
            regs[some] = registers([sets[i] for i in some])
            keys = band_keys(regs[some])
        counts = np.zeros(len(sets) + 1, np.int32)
        counts[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
        bands = pa.ListArray.from_arrays(pa.array(counts), pa.array(keys.reshape(-1).view(np.int64)))
        packed = pa.array([regs[i].tobytes() if sizes[i] else None for i in range(len(sets))], pa.binary())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(whole[0]), pa.array(whole[1]), packed, bands],
            ["doc_id", "n_shingles", "w1", "w2", "registers", "bands"],
        )

    schema = "doc_id bigint, n_shingles bigint, w1 bigint, w2 bigint, registers binary, bands array<bigint>"
    return map_text(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), sign, schema)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets satisfy 100 * intersection >= 75 * union."""
    pairs = freeze(pairs, "pairs")
    ids = freeze(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = attach(docs.select("doc_id", "text"), ids, "doc_id", "left_semi")
    # Repeated rows of one id are one document.
    texts = texts.dropDuplicates(["doc_id"])
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text")), "b")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text"))
        keep = [linked(x, y) for x, y in zip(one, other, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return map_text(with_both.select("a", "b", "text_a", "text"), verify, "a bigint, b bigint")


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """The link itself, on two full sets."""
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= 75 * (len(one) + len(other) - shared)


def with_sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` with the full shingle set of each document, as bytes."""
    ids = freeze(members.select("doc_id").distinct(), "open-ids")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    texts = attach(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return members.join(map_text(texts, describe, "doc_id bigint, shingles binary"), "doc_id")


def open_links(members: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` that join the components which still meet in a band.

    ``members``: key, doc_id, component, n_shingles, registers, shingles. Bands are cut into blocks of about ``BLOCK``
    members by hash, and each pair of blocks is one group, so that neither a task nor a row ever holds a whole band. A
    pair is looked at under the first band that it shares; if its estimate is near the bound, its full sets decide, unless
    links found before in the group have joined its components already. So a group returns fewer links than members.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = placed.withColumn("other", F.explode(every)).select(
        "key",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "doc_id",
        "component",
        "n_shingles",
        "registers",
        "shingles",
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids, comp = group["doc_id"].to_numpy(), group["component"].to_numpy().copy()
        n, block = group["n_shingles"].to_numpy().astype(float), group["block"].to_numpy()
        sets = [np.frombuffer(s.as_buffer(), U64) for s in group["shingles"]]
        regs = np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
        keys = band_keys(regs)
        own = U64(group["key"][0].as_py() % (1 << 64))
        band = int(np.flatnonzero(keys[0] == own)[0])
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        bound = 0.75 - SLACK * np.sqrt(0.75 * 0.25 / BUCKETS)
        found = []
        for i in np.flatnonzero(block == low):
            rest = np.flatnonzero((comp != comp[i]) & (block == high) & ((ids > ids[i]) | (low != high)))
            if not len(rest):
                continue
            rest = rest[~(keys[rest, :band] == keys[i, :band]).any(axis=1)]
            guess = estimate((regs[rest] == regs[i]).mean(axis=1), n[i], n[rest])
            fits = (np.minimum(n[rest], n[i]) >= 0.75 * np.maximum(n[rest], n[i])) & (guess >= bound)
            for j in rest[fits][np.argsort(-guess[fits], kind="stable")]:
                if comp[i] != comp[j] and linked(sets[i], sets[j]):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id with the same lower-cased words; ``component_id`` the smallest doc_id reachable
    over links. NULL and blank texts have an empty set and are linked with nothing. A NULL doc_id cannot be named by a
    link: its row keeps NULL as class and component and is kept. Rows that repeat a doc_id are one document: their
    texts should agree, and each row is returned. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = freeze(signatures(docs), "signatures")
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("w1", "w2").agg(F.min("doc_id").alias("class_id"))
    # The class joins on a hash that a third of the rows may share; both sides are shuffled, so the join can be split.
    classed = freeze(named.select("doc_id", "w1", "w2").join(classes, ["w1", "w2"]).select("doc_id", "class_id"), "classes")
    heads = attach(signed, freeze(classed.filter("doc_id = class_id").select("doc_id").distinct(), "heads"), "doc_id", "left_semi")
    heads = heads.dropDuplicates(["doc_id"])
    slots = heads.select("doc_id", F.explode("bands").alias("key"))
    shared = freeze(
        slots.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).filter("center <> last").drop("last"), "bands"
    )
    rays = freeze(attach(slots, shared, "key"), "rays")
    # One pair per document first: with the smallest of its bands' centers.
    stars = rays.groupBy("doc_id").agg(F.min("center").alias("center")).filter("doc_id <> center")
    links = freeze(confirmed(stars.select(F.col("center").alias("a"), F.col("doc_id").alias("b")), docs), "links")
    first = freeze(components(links), "components")
    labelled = rays.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    labelled = freeze(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    members = attach(labelled, freeze(mixed.select("key"), "mixed"), "key", "left_semi")
    members = members.join(heads.select("doc_id", "n_shingles", "registers"), "doc_id")
    more = freeze(open_links(with_sets(members, docs)).distinct(), "links")
    joined = first if more.isEmpty() else freeze(components(links.union(more)), "components")
    component = F.coalesce("component", "class_id")
    places = (
        classed.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        .groupBy("doc_id")
        .agg(F.min("class_id").alias("class_id"), F.min(component).alias("component_id"))
    )
    rows = signed.select("doc_id", "n_shingles").join(places, "doc_id", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
