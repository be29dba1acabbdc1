"""Repeated byte strings by a sparse suffix array, sorted the deep-shallow way.

A byte goes if a string of ``WINDOW`` bytes that covers it starts anywhere else too. Sorting every suffix of a corpus
would move each byte ``WINDOW`` times, so suffixes are sorted at anchors only: of every ``SPAN`` consecutive seeds
(``SEED`` bytes) the one with the smallest hash, the last of equal ones. Every window holds an anchor, equal windows
hold it at the same place, and an anchor whose seed occurs once lies in no repeat.

An anchor's key is the ``WINDOW`` bytes from it on, then the ``LEFT`` bytes before it, read backwards. Equal keys are
one key with a count (so a passage of a million copies is one row); their windows are repeats. The distinct keys are
range-partitioned, and each range is sorted: multikey quicksort over the first ``SHALLOW`` bytes, then a blind trie for
every group that agrees on all of them. Neighbours in that order share the longest runs: if two keys agree on ``r`` bytes
from the anchor on and ``l`` before it, their windows that begin ``200 - r`` to ``l`` bytes before the anchor are equal.

Each key is held against its ``NEIGHBOURS`` next ones on both sides. Farther ones and those across a border of ranges
can only share windows for which the order leaves room; these few are compared by hash in one aggregate over all ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import BASE, GRAM, PIECE, U64, _power_tables, freeze, joined_texts, map_text, mix, run_hashes, text_key

WINDOW, SEED = 200, 64
SPAN = WINDOW - SEED + 1
LEFT = WINDOW - SEED
KEY = WINDOW + LEFT
SHALLOW = 16  # bytes, a multiple of 8
NEIGHBOURS = 32
RANGE_ROWS = 40_000  # keys of one range, about 14 MB
PLACE_BITS = U64(24)
NO_ID = (1 << 63) - 1


# --- anchors ------------------------------------------------------------------------------------------------------
def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from every place on."""
    if len(data) < SEED:
        return np.empty(0, U64)
    power, inverse = _power_tables(int(BASE), 1 << max(16, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[SEED:] - sums[:-SEED]) * inverse[: len(data) - SEED + 1])


def chosen_places(seeds: np.ndarray) -> np.ndarray:
    """Place of the anchor of every window: the smallest of ``SPAN`` consecutive seeds, the last of equal ones."""
    mask = (U64(1) << PLACE_BITS) - U64(1)
    least, width = (seeds & ~mask) | (mask - np.arange(len(seeds), dtype=U64)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (mask - (least & mask)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and seeds of the anchors of all texts in the buffer, a piece at a time."""
    places, found = [np.empty(0, np.int64)], [np.empty(0, U64)]
    sizes = np.diff(offsets)
    for low in range(0, len(data), PIECE):
        seeds = seed_hashes(data[low : low + PIECE + WINDOW - 1])
        if len(seeds) < SPAN:
            break
        chosen = chosen_places(seeds)
        # A window may not reach the line feed behind its text.
        first, last = np.searchsorted(offsets, [low, low + len(chosen)], "right") - 1
        ends = np.repeat(offsets[first + 1 : last + 2], sizes[first : last + 1])[low - offsets[first] :][: len(chosen)]
        own = np.unique(chosen[np.arange(low, low + len(chosen)) + WINDOW < ends])
        places.append(own + low)
        found.append(seeds[own])
    all_places, first_of = np.unique(np.concatenate(places), return_index=True)
    return all_places, np.concatenate(found)[first_of]


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Size, digest and seeds of each text; a seed that it holds more than once stands there twice."""
    texts = batch.column("text")
    data, offsets = joined_texts(texts)
    places, seeds = anchors(data, offsets)
    cuts = np.searchsorted(places, offsets)
    lists = []
    for i in range(batch.num_rows):
        own, counts = np.unique(seeds[cuts[i] : cuts[i + 1]], return_counts=True)
        lists.append(np.repeat(own, np.minimum(counts, 2)).view(np.int64))
    bounds = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
    digests = [hashlib.sha256(data[offsets[i] : offsets[i + 1] - 1]).hexdigest() for i in range(batch.num_rows)]
    columns = [batch.column(name) for name in ("doc_id", "_doc", "_t1", "_t2")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(np.diff(offsets) - 1), pa.array(digests), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lists)))],
        ["doc_id", "_doc", "_t1", "_t2", "n_bytes", "kept_sha256", "seeds"],
    )


# --- keys ---------------------------------------------------------------------------------------------------------
def _key_hashes(data: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two hashes of the bytes around each place, with their extents."""
    out = np.empty((len(places), 2), U64)
    extents = mix((left * 1024 + right).astype(U64))
    for low in range(0, len(data), PIECE):
        rows = slice(*np.searchsorted(places, [low, low + PIECE]))
        if rows.start == rows.stop:
            continue
        start = max(0, low - LEFT)
        part = data[start : low + PIECE + WINDOW].astype(U64)
        begin, end = places[rows] - left[rows] - start, places[rows] + right[rows] - start
        for i, (salt, base) in enumerate(((1, BASE), (977, GRAM))):
            out[rows, i] = mix(run_hashes(part + U64(salt), begin, end, base) ^ extents[rows])
    return out


def _key_bytes(data: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(places), KEY), np.uint8)
    if len(places):
        ahead, back = np.arange(WINDOW), np.arange(LEFT)
        keys[:, :WINDOW] = np.where(ahead < right[:, None], data[np.minimum(places[:, None] + ahead, len(data) - 1)], 0)
        keys[:, WINDOW:] = np.where(back < left[:, None], data[np.maximum(places[:, None] - 1 - back, 0)], 0)
    return keys


KEY_ROWS = "h1 bigint, h2 bigint, n bigint, key binary, behind int, ahead int, nums array<bigint>, firsts array<int>, lasts array<int>"


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Distinct keys of the batch at anchors whose seed is shared, and where they stand (runs of places of a text)."""
    data, offsets = joined_texts(batch.column("text"))
    places, seeds = anchors(data, offsets)
    texts = np.searchsorted(offsets, places, "right") - 1
    shared, keep = batch.column("shared"), np.zeros(len(places), bool)
    cuts = np.searchsorted(places, offsets)
    for i in range(batch.num_rows):
        keep[cuts[i] : cuts[i + 1]] = np.isin(seeds[cuts[i] : cuts[i + 1]], shared[i].values.to_numpy().view(U64))
    places, texts = places[keep], texts[keep]
    if not len(places):
        return None
    left = np.minimum(places - offsets[texts], LEFT)
    right = np.minimum(offsets[texts + 1] - 1 - places, WINDOW)
    hashes = _key_hashes(data, places, left, right)
    order = np.lexsort((places, hashes[:, 1], hashes[:, 0]))
    places, texts, left, right, hashes = places[order], texts[order], left[order], right[order], hashes[order]
    new_key = np.concatenate(([True], (hashes[1:] != hashes[:-1]).any(axis=1)))
    new_run = new_key | np.concatenate(([True], (np.diff(places) != 1) | (np.diff(texts) != 0)))
    runs, heads = np.flatnonzero(new_run), np.flatnonzero(new_key)
    last_of_run = np.append(runs[1:], len(places)) - 1
    nums = batch.column("num").to_numpy()[texts[runs]]
    bounds = pa.array(np.append(np.searchsorted(runs, heads), len(runs)).astype(np.int32))
    lists = [nums, (places - offsets[texts])[runs].astype(np.int32), (places - offsets[texts])[last_of_run].astype(np.int32)]
    keys = _key_bytes(data, places[heads], left[heads], right[heads])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hashes[heads, 0].view(np.int64)),
            pa.array(hashes[heads, 1].view(np.int64)),
            pa.array(np.diff(np.append(heads, len(places)))),
            pa.array([k.tobytes() for k in keys], pa.binary()),
            pa.array(left[heads].astype(np.int32)),
            pa.array(right[heads].astype(np.int32)),
            *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists),
        ],
        ["h1", "h2", "n", "key", "behind", "ahead", "nums", "firsts", "lasts"],
    )


# --- sorting ------------------------------------------------------------------------------------------------------
def blind_trie_order(values: list[int], bits: int) -> list[int]:
    """Order of ``values`` (numbers of ``bits`` bits) by a trie that keeps only the places of branching bits.

    A value goes down by its bits at those places alone, is compared with the one value it arrives at, and is hung in
    above the first branching behind their first differing bit. Equal values follow each other.
    """
    skip: list[int] = []
    kids: list[list[int]] = []  # a leaf is the complement of its first value's number
    equals: dict[int, list[int]] = {}
    root = -1
    for i in range(1, len(values)):
        value, node = values[i], root
        while node >= 0:
            node = kids[node][value >> (bits - 1 - skip[node]) & 1]
        difference = value ^ values[~node]
        if not difference:
            equals.setdefault(~node, []).append(i)
            continue
        place = bits - difference.bit_length()
        above, side, node = -1, 0, root
        while node >= 0 and skip[node] < place:
            above, side = node, value >> (bits - 1 - skip[node]) & 1
            node = kids[node][side]
        larger = value >> (bits - 1 - place) & 1
        skip.append(place)
        kids.append([node, ~i] if larger else [~i, node])
        if above < 0:
            root = len(skip) - 1
        else:
            kids[above][side] = len(skip) - 1
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node < 0:
            order += [~node, *equals.get(~node, ())]
        else:
            stack += [kids[node][1], kids[node][0]]
    return order


def deep_shallow_order(keys: np.ndarray) -> np.ndarray:
    """Row numbers of the byte matrix ``keys`` in ascending order."""
    columns = np.ascontiguousarray(keys[:, :SHALLOW]).view(">u8").astype(U64)
    order: list[np.ndarray] = []
    stack = [(np.arange(len(keys)), 0)] if len(keys) else []
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 1:
            order.append(rows)
        elif depth == columns.shape[1]:
            values = [int.from_bytes(keys[r].tobytes(), "big") for r in rows]
            order.append(rows[blind_trie_order(values, 8 * keys.shape[1])])
        else:
            column = columns[rows, depth]
            sample = np.sort(column[:: max(1, len(column) // 9)])
            pivot = sample[len(sample) // 2]
            for part, below in ((column > pivot, depth), (column == pivot, depth + 1), (column < pivot, depth)):
                if part.any():
                    stack.append((rows[part], below))
    return np.concatenate(order) if order else np.empty(0, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes at the beginning of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


# --- judging ------------------------------------------------------------------------------------------------------
def _least_to_the_left(shared: np.ndarray, steps: int) -> np.ndarray:
    """For each row the least of ``shared`` over its last ``steps`` steps; rows with fewer have all of them."""
    out = shared.copy()
    for d in range(1, steps):
        out[d:] = np.minimum(out[d:], shared[:-d])
    return out


def judged(keys: np.ndarray, behind: np.ndarray, ahead: np.ndarray, counts: np.ndarray):
    """For sorted distinct keys: mask (row, bytes before the anchor) of the windows found twice; mask of those that only
    keys out of reach could repeat; the rows whose windows of the second mask have to be compared."""
    n, starts = len(keys), np.arange(LEFT + 1)
    possible = (WINDOW - starts <= ahead[:, None]) & (starts <= behind[:, None])
    repeated = possible & (counts > 1)[:, None]
    shared = np.minimum(np.concatenate(([WINDOW], _common(keys[:-1], keys[1:]))), WINDOW) if n > 1 else np.full(n, WINDOW)
    steps = np.zeros((n, LEFT + 2), np.int32)
    between = shared.copy()
    for d in range(1, min(NEIGHBOURS, n - 1) + 1):
        if d > 1:
            between[d:] = np.minimum(between[d:], shared[1 : n - d + 1])
        rows = np.flatnonzero(between[d:] >= SEED) + d
        if not len(rows):
            break
        right = np.minimum(between[rows], np.minimum(ahead[rows], ahead[rows - d]))
        left = np.minimum(_common(keys[rows, WINDOW:], keys[rows - d, WINDOW:]), np.minimum(behind[rows], behind[rows - d]))
        some = WINDOW - right <= left
        for own in (rows[some], rows[some] - d):
            np.add.at(steps, (own, (WINDOW - right)[some]), 1)
            np.add.at(steps, (own, left[some] + 1), -1)
    repeated |= possible & (np.cumsum(steps, axis=1)[:, :-1] > 0)
    # What a key farther away, or beyond the border (the first step of each direction), could still share.
    up = _least_to_the_left(shared, NEIGHBOURS + 1)
    down = _least_to_the_left(np.concatenate((shared[1:], [WINDOW]))[::-1], NEIGHBOURS + 1)[::-1]
    room = possible & (WINDOW - starts <= np.maximum(up, down)[:, None]) & (np.maximum(up, down) >= SEED)[:, None]
    open_rows = (room & ~repeated).any(axis=1)
    group = np.cumsum(np.concatenate(([0], shared[1:] < SEED))) if n else np.empty(0, np.int64)
    asked = np.isin(group, np.unique(group[open_rows])) | (n > 0 and (group == group[0]) | (group == group[-1]))
    return repeated, room, asked


VERDICTS = "h1 bigint, h2 bigint, low int, high int, w1 bigint, w2 bigint, ask boolean"


def _judge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one range of distinct keys. Rows without ``w1``: windows from ``low`` to ``high`` bytes before the anchor are
    repeated; the others: the window at ``low`` with its hash, ``ask`` if it is not known to be repeated."""
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(-1, KEY)
    order = deep_shallow_order(keys)
    keys = keys[order]
    h1, h2, behind, ahead, counts = (table.column(name).to_numpy()[order] for name in ("h1", "h2", "behind", "ahead", "n"))
    repeated, room, asked = judged(keys, behind, ahead, counts)
    edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1
    nothing = pa.nulls(len(rows), pa.int64())
    names = ["h1", "h2", "low", "high", "w1", "w2", "ask"]
    if len(rows):
        columns = [pa.array(h1[rows]), pa.array(h2[rows]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), nothing, nothing, pa.array(np.zeros(len(rows), bool))]
        yield pa.RecordBatch.from_arrays(columns, names)
    rows, before = np.nonzero(room & asked[:, None])
    for cut in range(0, len(rows), 50_000):
        part, at = rows[cut : cut + 50_000], before[cut : cut + 50_000]
        windows = (keys[r, WINDOW : WINDOW + o][::-1].tobytes() + keys[r, : WINDOW - o].tobytes() for r, o in zip(part, at, strict=True))
        hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows), np.int64).reshape(-1, 2)
        places = pa.array(at.astype(np.int32))
        columns = [pa.array(h1[part]), pa.array(h2[part]), places, places, pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(~repeated[part, at])]
        yield pa.RecordBatch.from_arrays(columns, names)


# --- removing -----------------------------------------------------------------------------------------------------
def _remove(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = joined_texts(batch.column("text"))
    starts, ends = batch.column("starts"), batch.column("ends")
    spans, kept = [], []
    for i in range(batch.num_rows):
        own = data[offsets[i] : offsets[i + 1] - 1]
        steps = np.zeros(len(own) + 1, np.int64)
        np.add.at(steps, starts[i].values.to_numpy(), 1)
        np.add.at(steps, ends[i].values.to_numpy(), -1)
        gone = np.cumsum(steps[:-1]) > 0
        edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)])
        kept.append(own[~gone].tobytes())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("num"),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        ],
        ["num", "spans", "kept", "left_sha256"],
    )


CUTS = "num bigint, spans array<struct<start:int,end:int>>, kept binary, left_sha256 string"


def repeated_strings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``docs`` (doc_id, text).

    One row per row of ``docs``: ``doc_id, n_bytes, num, copied, kept_sha256``: bytes of the text in UTF-8, the number of
    its content (NULL if shorter than a window), whether other rows hold the same text, digest of the whole text. Then one
    row per content that loses bytes and stands in one row only: ``num, spans, kept, left_sha256``: maximal removed runs
    (byte places, end exclusive), what is left (it may be cut inside a character) and its digest. A ``copied`` text of at
    least a window loses all of its bytes.

    NULL and empty texts and those shorter than a window lose nothing. Rows that repeat a text, with the same doc_id,
    another or none, are places of their own, so all of them lose it. Texts of every length are read whole, a piece at a
    time. Other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), *text_key(F.col("text")), "text")
    schema = "doc_id bigint, _doc bigint, _t1 bigint, _t2 bigint, n_bytes bigint, kept_sha256 string, seeds array<bigint>"
    scanned = freeze(map_text(docs, _scan, schema), "suffix-scan")
    contents = scanned.filter(f"n_bytes >= {WINDOW}").groupBy("_t1", "_t2").agg(F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("rows"), F.first("seeds").alias("seeds"))
    contents = freeze(contents.withColumn("num", F.monotonically_increasing_id()), "suffix-contents")
    seeds = contents.select("num", F.explode("seeds").alias("seed"))
    shared = freeze(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("seed"), "suffix-seeds")
    # Seeds follow the texts: shuffled at every size. A seed of very many texts is split by adaptive execution.
    marked = seeds.join(shared.hint("merge"), "seed").groupBy("num").agg(F.collect_set("seed").alias("shared"))
    marked = freeze(marked.join(contents.select("num", "_t1", "_t2", "_doc"), "num"), "suffix-marked")
    texts = docs.join(marked.hint("merge"), ["_t1", "_t2", "_doc"]).dropDuplicates(["_t1", "_t2", "_doc"])
    texts = freeze(texts.select("num", "text", "shared"), "suffix-texts")
    found = freeze(map_text(texts, _keys, KEY_ROWS), "suffix-keys")
    keys = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("key", "behind", "ahead")))
    keys = freeze(keys, "suffix-distinct")
    ranges = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count() // RANGE_ROWS + 1)
    verdicts = freeze(keys.repartitionByRange(ranges, "key").mapInArrow(_judge_range, VERDICTS), "suffix-verdicts")
    asked = verdicts.filter("w1 is not null")
    met = asked.groupBy("w1", "w2", "low").agg(F.count(F.lit(1)).alias("keys"), F.max("ask").alias("open")).filter("keys > 1 and open")
    answered = asked.filter("ask").join(met, ["w1", "w2", "low"], "left_semi").select("h1", "h2", "low", "high")
    repeats = verdicts.filter("w1 is null").select("h1", "h2", "low", "high").unionByName(answered)
    stands = found.select("h1", "h2", F.explode(F.arrays_zip("nums", "firsts", "lasts")).alias("at"))
    reached = stands.join(repeats.hint("merge"), ["h1", "h2"]).select("at.nums", (F.col("at.firsts") - F.col("high")).alias("start"), (F.col("at.lasts") - F.col("low") + WINDOW).alias("end"))
    single = contents.filter("rows = 1").select("num")
    lost = reached.groupBy(F.col("nums").alias("num")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")).join(single, "num")
    cuts = freeze(map_text(texts.select("num", "text").join(lost.hint("merge"), "num"), _remove, CUTS), "suffix-cuts")
    known = contents.select("_t1", "_t2", "num", (F.col("rows") > 1).alias("copied"))
    rows = scanned.drop("seeds").join(known, ["_t1", "_t2"], "left")
    return rows.select("doc_id", "n_bytes", "num", F.coalesce("copied", F.lit(False)).alias("copied"), "kept_sha256"), cuts


def digest(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    changed = cuts.select("num", removed.alias("cut"), F.size("spans").cast("bigint").alias("runs"), "left_sha256")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    joined = rows.join(changed, "num", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1).cast("bigint")).otherwise(F.coalesce("runs", F.lit(0).cast("bigint"))).alias("n_spans"),
        F.when(F.col("copied"), empty).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"),
    )
