"""Repeated passages by seed and extend: winnowed anchors propose, extended windows decide.

Seeds: of every 41 consecutive ten-word runs the one with the smallest hash (the last, if several) is an anchor. Ten
plus 41 minus one is 50, so every window of 50 words contains an anchor, and equal windows choose it at the same place.
Anchors are joined across documents by their hash: one that occurs in a single document cannot lie in a repeat.

Extension: around a seed that several documents share, the match is extended to both sides up to 50 words. All
documents of a seed are extended at once rather than pair by pair: the windows that hold the seed are compared by
content, with the smallest document of each content as the owner. A document's windows owned by a smaller document,
merged where they touch or overlap, are its maximal repeats of at least 50 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import U64, attach, freeze, gram_hashes, joined_texts, map_text, mix, separators, word_hashes

WINDOW, SEED = 50, 10
SPAN = WINDOW - SEED + 1


def anchor_places(seeds: np.ndarray) -> np.ndarray:
    """Place of the chosen seed of each ``SPAN`` consecutive ones: the smallest, the last of equal ones."""
    values, places, width = seeds, np.arange(len(seeds)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = values[:-step], values[step:]
        later = right <= left
        places = np.where(later, places[step:], places[:-step])
        values = np.where(later, right, left)
        width += step
    return places


def documents_with_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, offsets = word_hashes(batch.column("text"))
    return words, offsets, np.flatnonzero(np.diff(offsets) >= WINDOW)


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Anchors of each text, and what a text without repeats returns: its word count and digest."""
    words, offsets, long = documents_with_words(batch)
    seeds = gram_hashes(words, SEED)
    lists = [np.empty(0, U64)] * batch.num_rows
    for i in long:
        own = seeds[offsets[i] : offsets[i + 1] - SEED + 1]
        # One document counts once per seed.
        lists[i] = np.unique(own[np.unique(anchor_places(own))])
    bounds = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
    anchors = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lists).view(np.int64)))
    digests = kept_digests(batch.column("text"), [None] * batch.num_rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests), anchors],
        ["doc_id", "n_words", "kept_sha256", "anchors"],
    )


def kept_texts(texts: pa.Array, removed: list[np.ndarray | None]) -> list[bytes]:
    """The words of each text that are left, joined by one space. ``removed``: a mask over the text's words."""
    data, offsets = joined_texts(texts)
    kept = []
    for i, mask in enumerate(removed):
        own = data[offsets[i] : offsets[i + 1]]
        gap = separators(own)
        first = ~gap & np.concatenate(([True], gap[:-1]))
        keep = ~gap
        if mask is not None:
            number = np.maximum(np.cumsum(first) - 1, 0)
            keep &= ~mask[number] if len(mask) else keep
        # A kept word is preceded by a space: the separator in front of it, or a byte put before the text.
        before = np.concatenate((first[1:] & keep[1:], [False]))
        out = own[keep | before].copy()
        spaces = before[keep | before]
        out[spaces] = 32
        head = bool(len(own)) and bool(first[0] & keep[0])
        kept.append(out.tobytes() if head else out.tobytes()[1:])
    return kept


def kept_digests(texts: pa.Array, removed: list[np.ndarray | None]) -> list[str]:
    return [hashlib.sha256(text).hexdigest() for text in kept_texts(texts, removed)]


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Windows all of whose anchors are shared: ``doc_id, place, h1, h2`` (two hashes of the 50 words)."""
    words, offsets, long = documents_with_words(batch)
    seeds = gram_hashes(words, SEED)
    ids, shared = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("shared")
    out_ids, out_places, firsts, seconds = [], [], [], []
    for i in long:
        low, high = offsets[i], offsets[i + 1]
        known = np.sort(shared[int(i)].values.to_numpy().view(U64))
        own = seeds[low : high - SEED + 1]
        chosen = own[anchor_places(own)]
        slot = np.minimum(np.searchsorted(known, chosen), max(len(known) - 1, 0))
        at = np.flatnonzero(known[slot] == chosen) if len(known) else np.empty(0, np.int64)
        if len(at):
            mine = words[low:high]
            h1 = gram_hashes(mine, WINDOW)[at]
            out_ids.append(np.full(len(at), ids[i]))
            out_places.append(at)
            firsts.append(h1)
            seconds.append(gram_hashes(mix(mine ^ U64(WINDOW)), WINDOW)[at])
    if not out_ids:
        return None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate(out_ids).astype(np.int64)),
            pa.array(np.concatenate(out_places).astype(np.int32)),
            pa.array(np.concatenate(firsts).view(np.int64)),
            pa.array(np.concatenate(seconds).view(np.int64)),
        ],
        ["doc_id", "place", "h1", "h2"],
    )


def covered(begins: np.ndarray, ends: np.ndarray, n_words: int) -> np.ndarray:
    """Mask of the words inside the intervals."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, np.minimum(ends, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, begins, ends = batch.column("text"), batch.column("begins"), batch.column("ends")
    counts = batch.column("n_words").to_numpy()
    masks = [covered(begins[i].values.to_numpy(), ends[i].values.to_numpy(), int(counts[i])) for i in range(batch.num_rows)]
    kept = kept_texts(texts, masks)
    spans = []
    for mask in masks:
        edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array([int(m.sum()) for m in masks], pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ],
        ["doc_id", "n_removed", "kept_text", "kept_sha256", "spans"],
    )


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``docs`` (doc_id, text).

    All rows: ``doc_id, n_words, kept_sha256`` of the untouched words. Documents that lose words: ``doc_id, n_removed,
    kept_text, kept_sha256, spans``, the spans being the maximal repeats in word places, end exclusive.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id. NULL and short
    texts have no window and are left alone. Rows with a NULL doc_id neither lose words nor cause a loss: they have no
    place in the order. Rows that repeat a doc_id are one document and each loses the same words; their texts should
    agree. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = freeze(map_text(docs, _anchors, "doc_id bigint, n_words bigint, kept_sha256 string, anchors array<bigint>"), "anchors")
    # Documents of equal words: only the smallest id of each digest can own a window, the others lose all their words.
    heads = scanned.filter(f"doc_id is not null and n_words >= {WINDOW}").groupBy("kept_sha256").agg(F.min("doc_id").alias("head"))
    named = scanned.filter(f"doc_id is not null and n_words >= {WINDOW}").select("doc_id", "kept_sha256")
    copies = freeze(named.join(heads, "kept_sha256").filter("doc_id <> head").select("doc_id").distinct(), "copies")
    small = copies.count() <= 500_000
    rest = scanned.filter(f"doc_id is not null and n_words >= {WINDOW}").join(F.broadcast(copies) if small else copies, "doc_id", "left_anti")
    seeds = rest.select("doc_id", F.explode("anchors").alias("seed"))
    shared = freeze(
        seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("seed"), "seeds"
    )
    marked = freeze(attach(seeds, shared, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("shared")), "marked")
    # Lists of seeds and of intervals follow the texts: both sides are shuffled at every size.
    texts = docs.join(marked.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    windows = freeze(map_text(texts.select("doc_id", "text", "shared"), _windows, "doc_id bigint, place int, h1 bigint, h2 bigint"), "windows")
    owners = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner <> last")
    lost = windows.join(owners.drop("last"), ["h1", "h2"]).filter("doc_id <> owner").groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    # Windows that touch or overlap are one interval.
    begins = F.filter("places", lambda p, i: (i == 0) | (p > F.get("places", i - 1) + WINDOW))
    ends = F.filter("places", lambda p, i: (i == F.size("places") - 1) | (F.get("places", i + 1) > p + WINDOW))
    parts = lost.select("doc_id", begins.alias("begins"), F.transform(ends, lambda p: p + WINDOW).alias("ends"))
    n_words = scanned.select("doc_id", "n_words").dropDuplicates(["doc_id"])
    whole = copies.join(n_words, "doc_id").select("doc_id", F.array(F.lit(0)).alias("begins"), F.array(F.col("n_words").cast("int")).alias("ends"), "n_words")
    losses = freeze(parts.join(n_words, "doc_id").select("doc_id", "begins", "ends", "n_words").unionByName(whole), "losses")
    cut = map_text(
        docs.join(losses.hint("merge"), "doc_id").select("doc_id", "text", "begins", "ends", "n_words"),
        _remove,
        "doc_id bigint, n_removed bigint, kept_text string, kept_sha256 string, spans array<struct<start:int,end:int>>",
    )
    return scanned.select("doc_id", "n_words", "kept_sha256"), cut
