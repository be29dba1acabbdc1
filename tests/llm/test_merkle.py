"""The Merkle manifest against a plain tree: NULLs, repeated rows, single leaves, several stored levels, no rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import corpus
from pyspark.sql import functions as F

from bazaarflow.llm import merkle


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(doc_id, source, lang, n_chars, text) -> str:
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(hashes: list[str]) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels: list[list[str]], i: int) -> list[tuple[bool, str | None]]:
    out = []
    for level in levels[:-1]:
        out.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def plain(rows) -> list[tuple]:
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf_hash(doc_id, source, lang, n_chars, text), text, source, n_chars))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        for i, (known, number, leaf, text, source, n_chars) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            doc_id = number if known else None
            hit = known and zlib.crc32(str(number).encode()) % 7 == 0
            digest = leaf_hash(doc_id, source, g, n_chars + 1 if hit and n_chars is not None else n_chars, text)
            steps = way(trees[g], i) + way(top, order.index(g))
            for before, sibling in steps:
                digest = H(digest) if sibling is None else H(sibling, digest) if before else H(digest, sibling)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], "".join(s for _, s in steps if s), digest))
    return out


def found(frame) -> list[tuple]:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = merkle.merkle_manifest(frame, tampered).collect()
    return [(r.doc_id, *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "folded"))) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


SCHEMA = corpus.SCHEMA + ", tree string, pos string, depth string, root string"


def test_manifest_matches_plain_tree(spark):
    """NULL fields and groups, repeated rows, a group of one row, clashing column names."""
    own = [(i, t, None if i % 5 == 0 else "xx" if i % 3 else "yy", s, n) for i, t, _, s, n in corpus.rows()]
    own += [own[3], own[3], (None, "no id", "xx", None, None), (7, "alone", "", "s", 5)]
    frame = spark.createDataFrame([(*r, *"kzcabcd") for r in own], SCHEMA).repartition(4)
    expected = plain(own)
    assert ordered(found(frame)) == ordered(expected)
    assert sum(root != folded for *_, root, _, folded in expected) >= 3


def test_manifest_of_several_stored_levels(spark, monkeypatch):
    """Blocks of four and cells of sixteen leaves: long climbs, copied nodes, a large group beside small ones, many groups."""
    monkeypatch.setattr(merkle, "SPAN", 2)
    monkeypatch.setattr(merkle, "CELL_BITS", 4)
    monkeypatch.setattr(merkle, "CELL", 16)
    own = [(i, f"text {i}", "big" if i % 3 else f"g{i % 87:02d}", "s", i) for i in range(700)]
    frame = spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert ordered(found(frame)) == ordered(plain(own))


def test_one_row_and_no_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    own = [(1, None, None, None, None)]
    assert found(spark.createDataFrame(own, schema)) == plain(own)
    assert found(spark.createDataFrame([], schema)) == []


def test_tampering_is_seen_only_where_it_was_done(spark):
    own = [(i, "same text", "xx", "s", 9) for i in range(40)]
    frame = spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = merkle.merkle_manifest(frame, F.col("doc_id") == 3).collect()
    assert {r.doc_id for r in rows if r.folded != r.root} == {3}
    assert merkle.merkle_manifest(frame).filter("folded <> root").isEmpty()
