"""Every corpus operator against its plain version, with NULLs, empty and long texts, repeated rows, no rows at all."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import cube_mix, iblt, line_dedup, minhash, permutation_index, quality, secret_scan, substring_dedup, token_rollup, unigram

ROWS = corpus.rows()
PAIRS = [(i, t) for i, t, *_ in ROWS]
NOTHING: list = []


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark)


# --- near copies --------------------------------------------------------------------------------------------------
def test_near_duplicates_match_all_pairs(docs):
    expected = brute.near_duplicates(PAIRS)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(ROWS) + 2
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == expected[row.doc_id]
    assert sum(not kept for *_, kept in expected.values()) >= 14


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours in the chain are linked, its ends are not: the open bands have to find the inner links."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()} == expected
    assert len({component for _, component, _ in expected.values()}) == 1


def test_registers_keep_leading_zeros_and_mantissa():
    values = np.array([1 << 63, (1 << 63) | (1 << 62), 1 << 40, (1 << 40) | (1 << 39)], np.uint64)
    assert minhash.compress(values).tolist() == [0, 1 << 9, 23 << 10, (23 << 10) | (1 << 9)]


def test_estimate_is_close_after_correction():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.int64).astype(np.uint64)
    regs = minhash.registers([np.unique(pool[:1000]), np.unique(pool[250:1250])])
    share = (regs[0] == regs[1]).mean()
    assert abs(minhash.estimate(share, 1000.0, 1000.0) - 0.6) < 0.2


# --- repeated passages --------------------------------------------------------------------------------------------
def test_repeated_passages_match_every_window(docs):
    expected = brute.repeated_passages(PAIRS)
    rows, cut = substring_dedup.repeated_passages(docs)
    changed = {r.doc_id: r for r in cut.collect()}
    for row in rows.filter("doc_id is not null").collect():
        own = changed.get(row.doc_id)
        got = (row.n_words, own.n_removed if own else 0, own.kept_sha256 if own else row.kept_sha256)
        assert got == expected[row.doc_id]
        if own:
            assert hashlib.sha256(own.kept_text.encode()).hexdigest() == own.kept_sha256
            assert sum(s.end - s.start for s in own.spans) == own.n_removed
    assert sum(n > 0 for _, n, _ in expected.values()) >= 15


def test_lists_that_follow_the_texts_are_shuffled_and_short(spark, monkeypatch):
    """The joins of whole texts have one plan at every size; a full copy and a long passage are carried as one interval."""
    mapped, plain = [], substring_dedup.map_text
    monkeypatch.setattr(substring_dedup, "map_text", lambda df, *rest: mapped.append(df) or plain(df, *rest))
    words = [f"w{i}" for i in range(2000)]
    passages = [*words[:300], "apart", *words[500:900]]
    own = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(passages))]
    _, cut = substring_dedup.repeated_passages(spark.createDataFrame(own, "doc_id bigint, text string"))
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in cut.collect()} == {2: [(0, 2000)], 3: [(0, 300), (301, 701)]}
    for df in mapped[1:]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    carried = {r.doc_id: (r.begins, r.ends) for r in mapped[2].collect()}
    assert carried == {2: ([0], [2000]), 3: ([0, 301], [300, 701])}


def test_anchors_cover_every_window():
    seeds = np.random.default_rng(0).integers(0, 40, 500).astype(np.uint64)
    places = substring_dedup.anchor_places(seeds)
    for start, place in enumerate(places):
        part = seeds[start : start + substring_dedup.SPAN]
        assert place == start + max(np.flatnonzero(part == part.min()))


# --- lines --------------------------------------------------------------------------------------------------------
def _near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_line_dedup_matches_all_pairs(spark):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 1000]
    lines = [(i, n, line.strip(" \t\r")) for i, t, *_ in rows if t is not None for n, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[2]) >= line_dedup.MIN_CHARS)
    gone = defaultdict(list)
    for at, (i, n, line) in enumerate(lines):
        if any(_near(line, earlier) for _, _, earlier in lines[:at]):
            gone[i].append(n)
    assert sum(map(len, gone.values())) >= 6
    found = line_dedup.line_dedup(corpus.frame(spark, rows, repeat=False)).collect()
    for row in found:
        text = dict((i, t) for i, t, *_ in rows)[row.doc_id]
        assert list(row.removed) == gone[row.doc_id]
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[row.doc_id])
        assert row.text == kept and row.key == "k" and row.size == "z"
        assert row.n_lines == (0 if text is None else text.count("\n") + 1)


def test_lines_of_every_length_meet_their_neighbours(spark):
    """One edit at every kind of place of lines that are cut into several blocks; two edits are left alone."""
    base = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(700))
    rows, number = [(0, base)], 0
    for at in (0, 1, 232, 233, 234, 466, 467, 699):
        for text in (base[:at] + "#" + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + "#" + base[at:]):
            number += 1
            rows.append((number, text))
    rows.append((1000, "##" + base[2:]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(r.removed) for r in line_dedup.line_dedup(frame).collect()}
    # The last is near to a line that starts with one mark.
    assert got == {i: [0] if any(_near(t, u) for j, u in rows if j < i) else [] for i, t in rows}


def test_repeated_rows_lose_the_same_lines(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (2, f"{line}\nother words stand here alone"), (2, f"{line}\nother words stand here alone"), (None, line)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, tuple(r.removed)) for r in got) == Counter({(1, ()): 1, (2, (0,)): 2, (None, (0,)): 1})


def test_lines_meet_in_whatever_case(spark, tmp_path):
    """A banner in capitals and a heading in title case go, one edit included, from op4 and from the pipeline's stage."""
    import corpus_pipeline

    from bazaarflow.llm import queries

    line = "this is a line that many documents share"
    own = [(1, line), (2, f"{line.upper()}\nKept AS It Stands here"), (3, line.title()), (4, line.title().replace("Many", "Mony")), (5, "A line OF its own Stands Here")]
    frame = spark.createDataFrame(own, "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.removed for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: "", 2: "0", 3: "0", 4: "0", 5: ""}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, frame, str(tmp_path)).collect()}
    assert left == {1: line, 2: "Kept AS It Stands here", 5: own[4][1]}
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 1000]
    folded = line_dedup.line_dedup(corpus.frame(spark, rows, repeat=False), fold_case=True).collect()
    lines = [(i, n, line.strip(" \t\r").lower()) for i, t, *_ in rows if t is not None for n, line in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if len(x[2]) >= line_dedup.MIN_CHARS)
    gone = {(i, n) for at, (i, n, line) in enumerate(lines) if any(_near(line, earlier) for _, _, earlier in lines[:at])}
    assert {(r.doc_id, n) for r in folded for n in r.removed} == gone and len(gone) >= 9


# --- secrets ------------------------------------------------------------------------------------------------------
def test_secret_base_matches_plain_scan(docs):
    expected = brute.secrets(PAIRS)
    found = secret_scan.digest(secret_scan.secret_spans(docs)).collect()
    assert len(found) == len(ROWS) + 2
    for row in found:
        if row.doc_id is not None:
            assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == expected[row.doc_id]


def test_copied_values_are_told_from_owned_ones(spark):
    example, own, loose = "token=EXAMPLEexample1", "token=privateThing77", "Ab0" * 9
    rows = [(i, example, f"s{i}") for i in range(5)] + [(10, own, "s1"), (11, own, "s1"), (12, loose, "s2"), (13, loose, "s2")]
    rows += [(20 + i, "Xy1" * 9, f"s{i}") for i in range(4)]
    found = {r.doc_id: r for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(found[i].n_copied == 1 and found[i].n_live == 0 and len(found[i].spans) == 1 for i in range(5))
    assert found[10].n_live == 1 and found[12].n_live == 1 and len(found[12].spans) == 1
    assert all(not found[20 + i].spans for i in range(4))


# --- fingerprints -------------------------------------------------------------------------------------------------
def _paragraphs(text: str) -> set[str]:
    import regex

    return set(regex.findall(iblt.PIECES, text))


def test_fingerprints_match_plain_versions(spark):
    ordered = sorted(((i, t or "") for i, t in PAIRS), reverse=True)
    found = {r.doc_id: r for r in iblt.fingerprints(corpus.frame(spark, repeat=False)).collect()}
    assert len(found) == len(ROWS)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((row.near_edited, edited), (row.near_next, after)):
            a, b = _paragraphs(text), _paragraphs(other)
            assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    by_text = defaultdict(set)
    for i, text in PAIRS:
        by_text[text or ""].add(found[i].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_next_document_crosses_bucket_borders(spark, monkeypatch):
    monkeypatch.setattr(iblt, "BUCKET_DOCS", 3)
    rows = [(i * i, f"text {i}") for i in range(40)] + [(None, "none")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = frame.select(F.coalesce("doc_id", F.lit(iblt.FIRST)).alias("_doc"), "text", F.lit(0).alias("_t1"), F.lit(0).alias("_t2"))
    got = {r.text: r.next_text for r in iblt.with_next(keyed, ["text"]).collect()}
    order = [t for _, t in sorted(rows[:-1], reverse=True)] + ["none"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


# --- mixing -------------------------------------------------------------------------------------------------------
def _targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2 * sizes[s] for s in above}


def test_mix_meets_its_targets_and_repeats_itself(docs):
    found = cube_mix.mixed(docs).collect()
    again = cube_mix.mixed(docs.repartition(7)).collect()
    assert Counter(found) == Counter(again) and len(found) == len(ROWS) + 2
    sizes, taken = Counter(), Counter()
    for row in found:
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        assert row.taken in (0, row.size, 2 * row.size)
    targets = _targets(dict(sizes))
    for row in found:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(targets[row.source])
    for source, target in targets.items():
        # One document holds most words of its source: it is taken or not, and the others cannot make up for it.
        most = max(row.size for row in found if row.source == source)
        assert abs(taken[source] - target) <= 0.1 * target + max(60, most / 2), (source, target, taken[source])


def test_cube_draw_keeps_totals_and_chances():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 300)
    mean = np.zeros(300)
    for trial in range(200):
        drawn = cube_mix.fly(sizes, np.full(300, 0.3), rng.integers(0, 1 << 62, 300), True)
        assert set(drawn) <= {0.0, 1.0} and abs(drawn.sum() - 90) <= 2
        assert abs((drawn * sizes).sum() - 0.3 * sizes.sum()) <= 400
        mean += drawn / 200
    assert abs(mean.mean() - 0.3) < 0.01 and mean.max() < 0.55 and mean.min() > 0.1


def test_large_source_is_flown_in_groups(spark, monkeypatch):
    monkeypatch.setattr(cube_mix, "GROUP", 20)
    frame = spark.range(600).select(F.lit(0).cast("bigint").alias("source_no"), F.xxhash64("id").alias("row_key"), (F.col("id") % 37 + 1).alias("size"), F.lit(0.4).alias("chance"))
    drawn = cube_mix.balanced_draw(frame).join(frame, "row_key").agg(F.count("*").alias("n"), F.sum("extra").alias("k"), F.sum(F.col("extra") * F.col("size")).alias("w"), F.sum("size").alias("all")).first()
    assert drawn.n == 600 and abs(drawn.k - 240) <= 3 and abs(drawn.w - 0.4 * drawn["all"]) <= 40


# --- tokens -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Vocabulary.load()


def test_trie_finds_its_keys_and_no_others():
    keys = [(bytes([a, b][: 1 + (a + b) % 2]), a * 300 + b) for a in range(0, 256, 5) for b in range(0, 256, 7)]
    keys = list({k: v for k, v in keys}.items())
    trie = unigram.build_trie(keys)

    def find(key: bytes) -> int:
        state = 0
        for c in key:
            following = trie.base[state] + c + 1
            if trie.check[following] != state:
                return -1
            state = following
        return int(trie.value[state])

    assert all(find(k) == v for k, v in keys)
    assert find(b"\x01\x01\x01") == -1 and find(b"\x03") == -1


def test_encoding_is_best_by_exhaustion():
    pieces = [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]
    pieces += [(p, -float(s), "normal") for p, s in (("▁", 2), ("a", 3), ("b", 3.1), ("ab", 3.2), ("▁a", 2.5), ("ba", 4), ("aba", 7), ("▁▁", 3), ("é", 5))]
    own = unigram.Vocabulary.of(pieces)
    cost = {p.replace("▁", " "): -s for p, s, kind in pieces if kind == "normal"}
    worst = max(cost.values()) + unigram.UNKNOWN_COST

    def best(text: str) -> float:
        table = [0.0] + [float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            table[end] = min(table[start] + (cost.get(text[start:end]) or (worst if end - start == 1 else float("inf"))) for start in range(end))
        return table[-1]

    texts = ["ab", "aba ba", "  abab  a", "xé ab", "bababab", "", None, "▁a", "a" * 400 + " b"]
    ids = own.encode(pa.array(texts))
    names = {i: p.replace("▁", " ") for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
    for text, got in zip(texts, ids.to_pylist(), strict=True):
        total, rest, at = 0.0, (" " + text if text else "").encode(), 0
        while at < len(got):
            if got[at] in names:
                total, at = total + cost[names[got[at]]], at + 1
            else:
                width = next(w for w in (1, 2, 3, 4) if bytes(got[at : at + w]).decode(errors="ignore"))
                total, at = total + worst, at + width
        assert total == pytest.approx(best(rest.decode())), text
    assert [b.decode() for b in own.decode(ids).to_pylist()] == [t or "" for t in texts]


def test_encoding_agrees_with_the_library(vocabulary):
    """The same pieces and scores in the library's own unigram model give the same scores; ids differ at most in ties."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(unigram.VOCABULARY, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores, strict=True):
        piece.score = float(score)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for _, t in PAIRS if t and "▁" not in t]
    for ours, theirs in zip(vocabulary.encode(pa.array(texts)).to_pylist(), library.encode(texts), strict=True):
        assert vocabulary.scores[ours].sum() == pytest.approx(vocabulary.scores[theirs].sum(), abs=0.01)


def test_texts_come_back_from_their_pieces(docs, vocabulary):
    rows = unigram.encoded(docs, vocabulary)
    assert rows.filter("round_trip").count() == len(ROWS) + 2
    back = {r.doc_id: r.text for r in unigram.decoded(rows, vocabulary).collect()}
    assert all(back[i] == (t or "") for i, t in PAIRS)


# --- token counts -------------------------------------------------------------------------------------------------
def test_rollup_follows_signed_changes(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/rollup")
    schema = "doc_id bigint, version string, source string, lang string, tokens bigint, action string, seq bigint, extra string"
    batch = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
    state = lambda: {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert state() == {}
    first = batch([(1, "v", "a", "en", 10, "insert", 0), (2, "v", "a", None, 5, "insert", 0), (None, "v", "b", "en", 7, "insert", 0), (1, "v", "a", "en", 10, "insert", 0)])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert state() == {("a", "en", "v"): (1, 10), ("a", None, "v"): (1, 5), ("b", "en", "v"): (1, 7)}
    second = batch([(1, "v", "c", "en", 12, "revise", 1), (1, "v", "c", "en", 11, "revise", 0), (2, "v", None, None, None, "delete", 0), (9, "v", "a", "en", 1, "delete", 0), (None, "v", "b", "en", 8, "revise", 0)])
    assert rollup.commit("two", second)
    assert state() == {("c", "en", "v"): (1, 12), ("b", "en", "v"): (1, 8)}
    # A batch that was cut off before its commit is not seen, and is written anew.
    first.write.parquet(f"file://{tmp_path}/rollup/ledger/three")
    assert state() == {("c", "en", "v"): (1, 12), ("b", "en", "v"): (1, 8)}
    assert rollup.commit("three", batch([(2, "v", "a", None, 3, "insert", 0)]))
    assert state()["a", None, "v"] == (1, 3)
    with pytest.raises(ValueError, match="action"):
        rollup.commit("four", batch([(1, "v", "a", "en", 1, "upsert", 0)]))


def test_counts_by_a_byte_pair_tokenizer(docs):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r.tokens for r in token_rollup.counted(docs, "bpe-50k", token_rollup.bpe_counter(path)).collect()}
    assert all(got[i] == len(own.encode(t or "", add_special_tokens=False).ids) for i, t in PAIRS)


# --- search -------------------------------------------------------------------------------------------------------
def test_search_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2.0, (3000, 1))
    vectors[60] *= 12 / np.linalg.norm(vectors[60])
    vectors[100:400] = vectors[60]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors.astype(np.float32))]
    bad = [(9000, None, "x"), (9001, [0.0] * 16, "x"), (9002, [None] + [1.0] * 15, "x"), (9003, [float("nan")] * 16, "x"), (None, [1.0] * 16, "x"), (9004, [1.0], "x"), (9005, [], "x")]
    frame = spark.createDataFrame(rows + bad + rows[:3], "vec_id bigint, embedding array<float>, vector string").repartition(5)
    found = defaultdict(list)
    for r in permutation_index.nearest_vectors(frame, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    exact = np.array([v for _, v, _ in rows], np.float64)
    hits = 0
    for query in range(0, 3000, 20):
        scores = exact @ exact[query]
        best = [i for i in np.lexsort((np.arange(3000), -scores.round(9))) if i != query][:20]
        assert [r for r, *_ in found[query]] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v]) for _, v, s in found[query])
        hits += len({v for _, v, _ in found[query]} & set(best))
    assert hits / (150 * 20) >= 0.9 and set(found) == set(range(0, 3000, 20))
    # The nearest of the repeated vector are its copies by number.
    assert [v for _, v, _ in found[60]] == list(range(100, 120))


# --- quality ------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    rng = __import__("random").Random(4)
    rows, labels = [], []
    for i in range(600):
        text = corpus.sentence(rng, rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            text = " ".join(w + rng.choice(("$$$", "###")) for w in text.split()) if i % 8 else " ".join([text.split()[0]] * 60)
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 0 if bad else 1))
    labels += [(5, 0), (None, 1), (7, None)]
    docs = corpus.frame(spark, [*rows, (900, None, "en", "s", 0), (901, "", "en", "s", 0)], repeat=False)
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int")
    learned = {r.doc_id for r in quality.training_labels(labelled).collect()}
    assert learned == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 and i != 5}
    model = quality.train(docs, labelled)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(scored) == 602 and all(0 <= r.quality_score <= 1 and r.key == "k" for r in scored.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scored[i].quality_score >= quality.THRESHOLD) == bool(i % 4) for i in held)
    assert right / len(held) >= 0.95
    assert scored[900].quality_score == scored[901].quality_score


def test_one_class_gives_a_constant():
    ids, shares = quality.document_features(pa.array(["a b c"]))[0]
    model = quality.fit([(ids, shares, 1, 1.0)])
    assert model.scores(pa.array(["x", None])).min() > 0.5
    assert quality.fit([]).scores(pa.array(["x"]))[0] == 0.5


def test_training_rows_are_views_of_short_numbers(spark, monkeypatch):
    """What training holds in the driver: two bytes a feature number, no copy of what Arrow brought; a blank text has none."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.extend(rows) or quality.QualityModel(np.zeros(quality.BUCKETS), 0.0))
    docs = corpus.frame(spark, [(i, f"a text {i}" if i else None, "en", "s", 1) for i in (3, 1, 2, 0)], repeat=False)
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int"))
    kept = [i for i in range(4) if zlib.crc32(str(i).encode()) % 5]
    assert [label for _, _, label, _ in seen] == [i % 2 for i in kept]
    for i, (ids, shares, _, _) in zip(kept, seen, strict=True):
        own = quality.document_features(pa.array([f"a text {i}" if i else None], pa.string()))[0]
        assert ids.itemsize == 2 and not ids.flags.owndata and ids.tolist() == own[0].tolist() and shares.tolist() == own[1].tolist()


# --- no rows ------------------------------------------------------------------------------------------------------
def test_empty_tables(spark, vocabulary):
    docs = corpus.frame(spark, NOTHING, repeat=False)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert minhash.near_duplicates(docs).isEmpty() and line_dedup.line_dedup(docs).isEmpty() and iblt.fingerprints(docs).isEmpty()
    assert all(x.isEmpty() for x in substring_dedup.repeated_passages(docs))
    assert cube_mix.mixed(docs).isEmpty() and secret_scan.secret_spans(docs).isEmpty() and unigram.encoded(docs, vocabulary).isEmpty()
    assert quality.score(docs, quality.train(docs, labels)).isEmpty() and token_rollup.counted(docs, "words-1").isEmpty()
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert permutation_index.nearest_vectors(vectors, F.col("id") % 20 == 0, 20).isEmpty()
