"""Spelling variants against all pairs of words: NULLs, repeated rows, accents, lost letters, chains of forms, no rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from test_operators import _near

from bazaarflow.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, form string, root string, key string"


def plain(rows, every: int) -> dict[str, tuple]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        near = [x for x in words if x != w and _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w: str) -> str:
        return w if out[w][0] is None else root(out[w][0])

    return {w: (form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def corpus(seed: int = 5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aabaaa", "é" * 7, "x" * 300]
    words = []
    for w in base:
        at = rng.randrange(len(w))
        kinds = [w, w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "q" + w[at + 1 :], w[:1] + w[:1] + w[1:], w[:at] + "q" + w[at + 1 :] + "y"]
        for kind, n in zip(kinds, rng.sample([2, 5, 9, 30, 60, 180], 6), strict=True):
            words += [kind] * n
    for i in "ghijk":
        words += ["qrst" + i * 2] * 9 + ["qrst" + i * 3] * 90 + ["qrst" + i * 4] * 900
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in words[i * 200 : (i + 1) * 200])) for i in range(len(words) // 200 + 1)]
    return [*rows, rows[1], (None, rows[2][1]), (900, None), (901, ""), (902, "1234 --- ÀÉ×÷ÿÿÿ ÀÉ×÷ÿÿÿ"), (903, "ÀÉ×÷ÿÿÿ " * 5), (904, "words " * 30_000)]


@pytest.mark.parametrize("every", [3, 199])
def test_variants_match_all_pairs(spark, every):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "w", 1, "f", "r", "k") for r in rows], SCHEMA).repartition(3)
    expected = plain(rows, every)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame, every).collect()}
    assert found == expected
    if every == 199:
        assert sum(form is not None and root != form for form, root, *_ in expected.values()) >= 3


def test_counts_handed_on_early_add_up(spark, monkeypatch):
    """A task that may hold few words hands them on several times."""
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = {r.word: r.n for r in spelling.word_counts(frame).collect()}
    monkeypatch.setattr(spelling, "HELD", 5)
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == expected


def test_signatures_of_near_words_meet(spark):
    words = ["abcdef", "abcdeg", "abcdefg", "bcdefg", "fedcba", "aabbcc", "aabbbc", "abbcc"]
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    pairs = {(r.word, r.other) for r in spelling.near_pairs(frame).collect()}
    assert pairs == {(a, b) for a in words for b in words if a != b and _near(a, b)}


def test_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
