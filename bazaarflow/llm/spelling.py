"""Spelling variants by PartEnum signatures over letter multisets.

A word's letters form a multiset, read as a binary vector with one place per (letter, how often it came before). One
inserted or deleted letter changes one place; a replaced letter changes two. So two words at edit distance one have
vectors of Hamming distance one (lengths differ by one) or two (equal lengths).

PartEnum: the places are partitioned into ``n`` parts by letter, and all ways to leave out ``k`` parts are enumerated.
Vectors within distance ``k`` agree on all places of at least ``n - k`` parts, hence on one signature: the letters of
the parts that are kept. The signatures are exact, so the equi-join loses no pair. As the order of letters is known too,
a signature also holds one half of the word as it stands: a single edit leaves the front or the back half as it is. What
meets under a signature is verified by its edit distance within the join; no list of a signature's words is built.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import freeze, small_batches

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
# Parts of the vector, for distance two (replaced letters) and one (lengths differ).
REPLACED_PARTS, SHIFTED_PARTS = 5, 4
# Words a task counts before it hands them on.
HELD = 300_000
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def damaged(word: str, h: int, every: int) -> str:
    """The word as it is read: without one letter if ``every`` divides its hash."""
    if h % every:
        return word
    place = h % len(word)
    return word[:place] + word[place + 1 :]


def _read_words(doc_id: int | None, text: str, every: int, seen: Counter) -> None:
    # Lower-casing bytes touches A-Z only.
    own = Counter(RUN.findall(text.encode().lower().decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in own.items():
        h = zlib.crc32(word.encode(), start)
        if h % every:
            seen[word] += n
        else:
            seen[damaged(word, h, every)] += n


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """``word, n`` of words with at least six letters and five occurrences.

    Every task counts its own words; only these counts are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if len(w) >= LEAST_LENGTH}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    _read_words(doc_id, text, every, seen)
            if len(seen) >= HELD:
                yield handed()
        if seen:
            yield handed()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _signatures(letters: Column, parts: int, left_out: int) -> Column:
    """Array of all signatures of the multiset: its letters without those of ``left_out`` of the ``parts``."""
    def kept(gone: tuple[int, ...]) -> Column:
        return F.array_join(F.filter(letters, lambda c: ~(F.ascii(c) % parts).isin(*gone)), "")

    return F.array(*(F.concat(F.lit(f"{'.'.join(map(str, gone))}/"), kept(gone)) for gone in combinations(range(parts), left_out)))


def _keys(words: DataFrame) -> DataFrame:
    """``word, n, side, key``: side 0 meets side 0 (equal lengths), 1 (the shorter word) meets 2 (the longer one)."""
    sorted_letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    lettered = words.select("word", "n", F.length("word").alias("chars"), sorted_letters.alias("letters"))
    replaced = _signatures(F.col("letters"), REPLACED_PARTS, 2)
    shifted = _signatures(F.col("letters"), SHIFTED_PARTS, 1)
    signed = lettered.select("word", "n", "chars", replaced.alias("replaced"), shifted.alias("shifted"))
    # (side, length that both words agree on, signatures)
    views = F.array(
        F.struct(F.lit(0).alias("side"), F.col("chars").alias("length"), F.col("replaced").alias("signatures")),
        F.struct(F.lit(1).alias("side"), F.col("chars").alias("length"), F.col("shifted").alias("signatures")),
        F.struct(F.lit(2).alias("side"), (F.col("chars") - 1).alias("length"), F.col("shifted").alias("signatures")),
    )
    viewed = signed.select("word", "n", "chars", F.inline(views))
    front = F.floor(F.col("length") / 2).cast("int")
    halves = F.array(
        F.concat(F.lit("<"), F.substring("word", F.lit(1), front)),
        F.concat(F.lit(">"), F.substring("word", F.col("chars") - (F.col("length") - front) + 1, F.col("chars"))),
    )
    halved = viewed.select("word", "n", "side", "length", F.explode(halves).alias("half"), "signatures")
    exploded = halved.select("word", "n", "side", "length", "half", F.explode("signatures").alias("signature"))
    return exploded.select("word", "n", "side", F.xxhash64((F.col("side") == 0).cast("int"), "length", "half", "signature").alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: both directions of every pair at edit distance one, each once."""
    keys = _keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    meets = ((F.col("a.side") == 0) & (F.col("b.side") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("a.side") == 1) & (F.col("b.side") == 2))
    close = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    # One join at every size; a signature of very many words is split by adaptive execution.
    pairs = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & meets & close)
    found = pairs.select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n")).distinct()
    both = F.array(
        F.struct(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("other"), F.col("y_n").alias("other_n")),
        F.struct(F.col("y").alias("word"), F.col("y_n").alias("n"), F.col("x").alias("other"), F.col("x_n").alias("other_n")),
    )
    return found.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, by doubling: counts grow fivefold along a chain, so few rounds are needed."""
    current = freeze(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        stepped = freeze(current.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if stepped.filter("moved").isEmpty():
            return stepped.select("word", "root")
        current = stepped.select("word", "root")


def spelling_variants(docs: DataFrame, every: int = 199) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (doc_id, text).

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where ``every`` divides
    the CRC-32 of ``<doc_id>:<run>``, one letter is lost (a NULL doc_id counts as empty text). A word's ``form`` is the
    most frequent of its near words (of equal ones the smallest), if that has at least five times its occurrences;
    ``root`` ends the chain of forms. Repeated rows count as often as they stand there; NULL and empty texts have no
    words, texts and words of any length are read whole; other columns are ignored. No rows give no words.
    """
    words = freeze(word_counts(docs, every), "spelling-words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form"))).alias("best")
    near = freeze(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "spelling-near")
    named = words.join(near, "word", "left")
    chosen = -F.col("best.order") >= RATIO * F.col("n")
    table = named.select(
        "word", F.when(chosen, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, -F.col("best.order")).alias("form_n")
    )
    table = freeze(table, "spelling-forms")
    roots = _roots(table.filter("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
