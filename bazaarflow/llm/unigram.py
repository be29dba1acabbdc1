"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is one string of bytes in which a space is the whitespace marker; a marker is put in front of every non-empty
text. Among all ways to cut it into pieces the one with the greatest sum of log scores is taken; of equal sums the one
whose last differing piece is longer. A character that is no piece itself costs ten less than the worst piece and is
written as its bytes. The text's own U+2581 is such a character, so decoding returns every text exactly.

No piece holds a marker behind another character, so a best path can be found for every run "marker, word" on its own.
A batch's distinct runs are therefore solved once, all of them at the same time: the trie is walked from every
character in lockstep, and the best scores are carried forward byte by byte over all runs. A vocabulary with inner
markers is solved by whole texts instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import map_text

MARKER = "▁"
UNKNOWN_COST = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Trie:
    """Double array: the child of state ``s`` by byte ``c`` is ``t = base[s] + c + 1`` if ``check[t] == s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[tuple[bytes, int]]) -> Trie:
    """Place every state's children at the first offset where all of their cells are free.

    Several children are looked for from ``dense`` on, which moves up when a search was long: a few free cells in front
    of it are given up, and the build stays linear.
    """
    keys = sorted(keys)
    size = 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[:257] = False  # else low cells that no byte can reach would be looked at again and again
    first_free = dense = 257
    todo = [(0, 0, len(keys), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        if low < high and len(keys[low][0]) == depth:
            value[state] = keys[low][1]
            low += 1
        children, at = [], low
        while at < high:
            byte, start = keys[at][0][depth], at
            while at < high and keys[at][0][depth] == byte:
                at += 1
            children.append((byte + 1, start, at))
        if not children:
            continue
        codes = np.array([c for c, _, _ in children])
        while first_free < size and not free[first_free]:
            first_free += 1
        begin = offset = max((first_free if len(codes) == 1 else dense) - int(codes[0]), 0)
        while True:
            if offset + 2 * 257 >= size:
                grown = 2 * size
                base, check, value = (np.concatenate((a, np.full(size, fill, np.int32))) for a, fill in ((base, 0), (check, -1), (value, -1)))
                free, size = np.concatenate((free, np.ones(size, bool))), grown
            # Try 256 offsets at a time.
            fits = free[offset + codes[0] : offset + codes[0] + 256].copy()
            for code in codes[1:]:
                fits &= free[offset + code : offset + code + 256]
            if fits.any():
                offset += int(np.argmax(fits))
                break
            offset += 256
        if len(codes) > 1 and offset > begin + 512:
            dense = begin + (offset - begin) // 2
        base[state] = offset
        for code, start, end in children:
            check[offset + code], free[offset + code] = state, False
            todo.append((offset + code, start, end, depth + 1))
    return Trie(base, check, value)


@dataclass
class Vocabulary:
    """Pieces by id as bytes (marker as space), log scores, the ids of the 256 bytes, and the trie of ordinary pieces."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: Trie
    inner_markers: bool

    def plain(self) -> tuple:
        """Arrays only, for tasks; ``from_plain`` is the way back."""
        return self.pieces, self.scores, self.byte_ids, (self.trie.base, self.trie.check, self.trie.value), self.inner_markers

    @classmethod
    def from_plain(cls, plain: tuple) -> Vocabulary:
        pieces, scores, byte_ids, trie, inner = plain
        return cls(pieces, scores, byte_ids, Trie(*trie), inner)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> Vocabulary:
        """From (piece, log score, kind) in id order; kind is ``normal``, ``byte`` (written <0xNN>) or ``control``."""
        surface, byte_ids = [], np.full(256, -1, np.int32)
        for number, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_ids[int(piece[3:5], 16)] = number
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append(piece.replace(MARKER, " ").encode() if kind == "normal" else b"")
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary lacks pieces for some bytes")
        normal = [(surface[i], i) for i, (_, _, kind) in enumerate(pieces) if kind == "normal"]
        scores = np.array([score for _, score, _ in pieces], np.float64)
        inner = any(b" " in key.lstrip(b" ") for key, _ in normal)
        return cls(surface, scores, byte_ids, build_trie(normal), inner)

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        """From a SentencePiece model file. Merge-ranked models hold ranks, not probabilities: their pieces get the
        log of a Zipf law over the rank. ``path`` is read on the driver and never copied."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in range(model.get_piece_size())]
        scores = [model.get_score(i) for i in range(len(kinds))]
        ordinary = [i for i, kind in enumerate(kinds) if kind == "normal"]
        if min(scores[i] for i in ordinary) < -1000:
            harmonic = float(np.sum(1.0 / np.arange(1, len(ordinary) + 1)))
            for rank, i in enumerate(ordinary, 1):
                scores[i] = -float(np.log(rank * harmonic))
        return cls.of([(model.id_to_piece(i), scores[i], kind) for i, kind in enumerate(kinds)])

    def _edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces at all characters: start, end, score, id (-1: bytes). ``ends``: for each byte, its run's end."""
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.minimum(np.append(begins, len(data))[1:], ends[begins])
        found, active, state, depth = [], begins, np.zeros(len(begins), np.int64), 0
        while len(active):
            inside = active + depth < ends[active]
            active, state = active[inside], state[inside]
            following = self.trie.base[state] + data[active + depth] + 1
            valid = self.trie.check[following] == state
            active, state, depth = active[valid], following[valid], depth + 1
            value = self.trie.value[state]
            hit = value >= 0
            found.append((active[hit], active[hit] + depth, value[hit]))
        starts, stops, ids = (np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        single = np.zeros(len(data) + 1, bool)
        upto = np.zeros(len(data) + 1, np.int64)
        upto[begins] = after
        single[starts[upto[starts] == stops]] = True
        bare = ~single[begins]
        starts = np.concatenate((starts, begins[bare]))
        stops = np.concatenate((stops, after[bare]))
        worst = self.scores[self.trie.value[self.trie.value >= 0]].min() - UNKNOWN_COST
        scores = np.concatenate((self.scores[ids], np.full(int(bare.sum()), worst)))
        return starts, stops, scores, np.concatenate((ids, np.full(int(bare.sum()), -1)))

    def _solve(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of every run ``data[bounds[i]:bounds[i + 1]]``: ids back to back, and their bounds."""
        lengths = np.diff(bounds)
        runs = np.repeat(np.arange(len(lengths)), lengths)
        starts, stops, scores, ids = self._edges(data, bounds[1:][runs])
        owner = runs[starts]
        # Every run has a slot for each of its bytes and one for its end.
        place, slot_from, slot_to = stops - bounds[owner], starts + owner, stops + owner
        order = np.lexsort((starts, slot_to, place))
        starts, stops, scores, ids, place, slot_from, slot_to = (a[order] for a in (starts, stops, scores, ids, place, slot_from, slot_to))
        best = np.full(len(data) + len(lengths), -np.inf)
        best[bounds[:-1] + np.arange(len(lengths))] = 0.0
        chosen = np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            sums = best[slot_from[low:high]] + scores[low:high]
            heads = np.flatnonzero(np.diff(slot_to[low:high], prepend=-1))
            top = np.maximum.reduceat(sums, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, high - low)))
            # Edges of one end are in order of their starts: the first of the best is the longest piece.
            at = np.minimum.reduceat(np.where(sums == top[group], np.arange(high - low), high - low), heads)
            ends = slot_to[low:high][heads]
            best[ends], chosen[ends] = top, low + at
        taken, alive, cursor = [], np.arange(len(lengths))[lengths > 0], (bounds[1:] + np.arange(len(lengths)))[lengths > 0]
        while len(alive):
            edge = chosen[cursor]
            taken.append(edge)
            cursor = slot_from[edge]
            more = cursor > bounds[alive] + alive
            alive, cursor = alive[more], cursor[more]
        edges = np.sort(np.concatenate(taken)) if taken else np.empty(0, np.int64)
        edges = edges[np.lexsort((starts[edges],))]
        width = np.where(ids[edges] < 0, stops[edges] - starts[edges], 1)
        out = np.repeat(ids[edges], width)
        inner = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
        raw = np.repeat(ids[edges] < 0, width)
        out[raw] = self.byte_ids[data[(np.repeat(starts[edges], width) + inner)[raw]]]
        counts = np.bincount(runs[starts[edges]], width, len(lengths)).astype(np.int64)
        return out.astype(np.int32), np.concatenate(([0], np.cumsum(counts)))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Piece ids of every text; NULL and empty texts have none."""
        whole = pc.fill_null(texts, "").cast(pa.large_string())
        marker = pc.if_else(pc.equal(pc.binary_length(whole), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        marked = pc.binary_join_element_wise(marker, whole, pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(marked.buffers()[1], np.int64)[: len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if not self.inner_markers:
            space = data == 32
            first[:-1] |= space & ~np.concatenate(([False], space[:-1]))
        first[-1] = True
        cuts = np.flatnonzero(first)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = runs.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        ids, piece_bounds = self._solve(np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: bounds[-1]], bounds)
        lists = pa.LargeListArray.from_arrays(pa.array(piece_bounds), pa.array(ids))
        flat = lists.take(runs.indices).flatten()
        sizes = np.concatenate(([0], np.cumsum(np.diff(piece_bounds)[runs.indices.to_numpy()])))
        return pa.ListArray.from_arrays(pa.array(sizes[np.searchsorted(cuts, offsets)].astype(np.int32)), flat)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts' bytes: pieces back to back, markers as spaces, without the marker in front."""
        surface = pa.array(self.pieces, pa.large_binary())
        flat = ids.flatten()
        joined = surface.take(flat)
        data = b"" if not len(flat) else joined.buffers()[2].to_pybytes()
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False))))
        bounds = ends[np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))]
        return pa.array([data[a + 1 if data[a : a + 1] == b" " else a : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, piece_ids, round_trip`` for every row of ``docs`` (doc_id, text).

    NULL and empty texts have no pieces and round-trip to the empty text; so does a NULL doc_id's row keep its NULL.
    Repeated rows are encoded each. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())  # one vocabulary, a fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = Vocabulary.from_plain(shared.value), batch.column("text")
        ids = own.encode(texts)
        is_byte = np.zeros(len(own.pieces) + 1, bool)
        is_byte[own.byte_ids] = True
        running = np.concatenate(([0], np.cumsum(is_byte[ids.values.to_numpy()])))
        bounds = ids.offsets.to_numpy()
        same = pc.equal(own.decode(ids), pc.fill_null(texts, "").cast(pa.binary()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(running[bounds]).astype(np.int64)), ids, same],
            ["doc_id", "n_pieces", "n_byte_pieces", "piece_ids", "round_trip"],
        )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_text(rows, run, f"doc_id {kind}, n_pieces bigint, n_byte_pieces bigint, piece_ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (doc_id, piece_ids) back to ``doc_id, text``; bytes that are no UTF-8 become the replacement character."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.plain())

    def run(batches):
        for batch in batches:
            texts = [b.as_py().decode("utf-8", "replace") for b in Vocabulary.from_plain(shared.value).decode(batch.column("piece_ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "piece_ids").mapInArrow(run, f"doc_id {kind}, text string")
