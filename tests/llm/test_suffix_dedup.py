"""Repeated byte strings against every window: NULLs, repeated rows, periodic and very long texts, characters of several
bytes, keys out of reach of their partners, no rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import pytest

from bazaarflow.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, num bigint, n_bytes bigint, key string, seeds string"


def plain(rows) -> list[tuple]:
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + 200] for _, t in texts for p in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows) -> list[tuple]:
    frame = spark.createDataFrame([(*r, 1, 2, "k", "s") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in suffix_dedup.digest(*suffix_dedup.repeated_strings(frame)).collect()), key=str)


def edited(rng: random.Random, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("xyzé")
    return "".join(out)


def hard_rows(seed: int = 1):
    """Many keys share a seed but differ on both sides, so that equal windows lie far apart in the order."""
    rng = random.Random(seed)
    core = corpus.sentence(rng, 60)
    heads, tails = [corpus.sentence(rng, 12) for _ in range(9)], [corpus.sentence(rng, 12) for _ in range(9)]
    rows = [f"{rng.choice(heads)[i % 7 :]} {core[: 120 + i % 5]} {rng.choice(tails)[: 60 - i % 11]}" for i in range(120)]
    rows += [edited(rng, core + tails[0] + heads[0], 1 + i % 3) for i in range(40)]
    rows += [core, f"{core} {core}", "a" * 900, "ab" * 700, "a" * 250, "a" * 199, "a" * 200, "é" * 150, "日本" * 80]
    return list(enumerate(rows))


def test_given_corpus_matches_every_window(spark):
    own = [(i, t) for i, t, *_ in corpus.rows()]
    own += [own[3], own[30], own[30], (None, own[31][1]), (None, own[32][1]), (None, own[32][1] + "."), (None, None)]
    expected = plain(own)
    assert found(spark, own) == expected
    assert sum(0 < n < size for _, size, n, *_ in expected) >= 10


@pytest.mark.parametrize("neighbours,range_rows", [(8, 40_000), (1, 40_000), (1, 60)])
def test_partners_out_of_reach_are_found(spark, monkeypatch, neighbours, range_rows):
    monkeypatch.setattr(suffix_dedup, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", range_rows)
    rows = hard_rows()
    assert found(spark, rows) == plain(rows)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(4)
    long = corpus.sentence(rng, 4000)
    rows = [(1, long), (2, long[3000:9000] + corpus.sentence(rng, 50)), (3, corpus.sentence(rng, 900) + long[9990:10250]), *hard_rows()[:20]]
    assert found(spark, rows) == plain(rows)


def test_order_is_that_of_plain_sorting():
    rng = random.Random(0)
    pool = [bytes(rng.choice(b"ab") for _ in range(suffix_dedup.KEY)) for _ in range(60)]
    keys = [p[:cut] + bytes(suffix_dedup.KEY - cut) for p in pool for cut in (5, 16, 17, 40, 200, 336)] + pool[:5] + [bytes([255]) * suffix_dedup.KEY]
    rng.shuffle(keys)
    matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    order = suffix_dedup.deep_shallow_order(matrix)
    assert sorted(order.tolist()) == list(range(len(keys)))
    assert [keys[i] for i in order] == sorted(keys)
    assert suffix_dedup.blind_trie_order([5], 3) == [0]


def test_equal_windows_choose_the_same_anchor():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2400] = data[500:900]
    places = suffix_dedup.chosen_places(suffix_dedup.seed_hashes(data))
    for p in range(500, 700):
        assert places[p] - p == places[p + 1500] - p - 1500


def test_no_rows_and_short_rows(spark):
    assert found(spark, []) == []
    rows = [(1, None), (2, ""), (2, "short"), (3, "short")]
    assert found(spark, rows) == plain(rows)
