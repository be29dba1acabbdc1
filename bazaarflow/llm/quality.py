"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A token's features are the word itself, its character n-grams of three to five bytes between word marks, and the pair
with the word before it; a pair of equal words is written as a ditto, so that repetition is one feature whatever the
word. Each feature owns a row of a hashed embedding table. A token is the mean of its subword rows averaged with its
pair's row, a document the mean of its tokens; softmax over two classes gives the score. Table and output layer are learned together by numpy stochastic
gradient descent with adaptive steps.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` per class), chosen by hash. Scoring is one pass over all
documents: the model is linear behind the table, so table times output layer is one number per feature, and every
distinct word of a batch is evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import BASE, U64, freeze, joined_texts, map_text, mix, run_hashes, word_spans

SAMPLE = 2_000
BUCKETS, DIMENSION = 1 << 16, 16
GRAMS = (3, 4, 5)
EPOCHS, STEP = 8, 0.5
THRESHOLD = 0.3


def token_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as numbers of distinct words, their text offsets, pair features, and the distinct words' feature lists."""
    data, offsets = joined_texts(texts)
    starts, ends = word_spans(data)
    bounds = np.searchsorted(starts, offsets)
    raw = mix(run_hashes(data.astype(U64) + U64(1), starts, ends, BASE) + (ends - starts).astype(U64))
    hashes, first, token = np.unique(raw, return_index=True, return_inverse=True)
    before = np.concatenate((np.zeros(1, U64), raw[:-1])) if len(raw) else raw
    pair = np.where(before == raw, U64(7), mix(before * U64(3) + raw))
    pair[bounds[:-1][np.diff(bounds) > 0]] = U64(11)
    # Distinct words between marks, back to back in one buffer.
    lengths = (ends - starts)[first] + 2
    marks = np.cumsum(np.concatenate(([0], lengths)))
    buffer = np.full(int(marks[-1]), ord("<"), np.uint8)
    inside = np.ones(len(buffer), bool)
    inside[marks[:-1]] = inside[marks[1:] - 1] = False
    buffer[marks[1:] - 1] = ord(">")
    source = np.repeat(starts[first] - marks[:-1] - 1, lengths) + np.arange(len(buffer))
    buffer[inside] = data[source[inside]]
    owner = np.repeat(np.arange(len(first)), lengths)
    keys, owners = [hashes], [np.arange(len(first))]
    wide = buffer.astype(U64) + U64(1)
    for n in GRAMS:
        at = np.arange(max(len(buffer) - n + 1, 0))
        at = at[owner[at] == owner[at + n - 1]] if len(at) else at
        keys.append(mix(run_hashes(wide, at, at + n, BASE) + U64(n)))
        owners.append(owner[at])
    return token, bounds, (pair % U64(BUCKETS)).astype(np.int64), (np.concatenate(keys) % U64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def document_features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse weights of each text: feature numbers (distinct) and their shares of the mean."""
    token, bounds, pair, features, owners = token_features(texts)
    count = np.bincount(owners, minlength=int(token.max()) + 1 if len(token) else 0)
    order = np.argsort(owners, kind="stable")
    features, heads = features[order], np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        words, times = np.unique(token[low:high], return_counts=True)
        sizes = count[words]
        places = np.repeat(heads[words] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(words) else np.empty(0, np.int64)
        share = np.concatenate((np.repeat(times / sizes, sizes), np.ones(high - low))) / max(2 * (high - low), 1)
        ids, inverse = np.unique(np.concatenate((features[places], pair[low:high])), return_inverse=True)
        out.append((ids.astype(np.int32), np.bincount(inverse, share, len(ids)).astype(np.float32)))
    return out


@dataclass
class QualityModel:
    """One number per feature and the intercept: the difference of the two classes' outputs."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        token, bounds, pair, features, owners = token_features(texts)
        count = np.bincount(owners, minlength=int(token.max()) + 1 if len(token) else 0)
        word = np.bincount(owners, self.weights[features], len(count))
        value = (word[token] / count[token] + self.weights[pair]) / 2
        total = np.concatenate(([0.0], np.cumsum(value)))
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.intercept, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int, float]], seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over (features, shares, label, weight). One class only gives its constant score."""
    labels = {label for _, _, label, _ in rows}
    if len(labels) < 2:
        return QualityModel(np.zeros(BUCKETS), {0: -5.0, 1: 5.0}[labels.pop()] if labels else 0.0)
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    seen, seen_output, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((2, DIMENSION), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        for i in random.permutation(len(rows)):
            ids, shares, label, weight = rows[i]
            picked = table[ids]
            hidden = shares @ picked
            logits = output @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            error *= weight
            back = error @ output
            slope = np.outer(error, hidden)
            seen_output += slope**2
            output -= step * slope / np.sqrt(seen_output)
            seen_bias += error**2
            bias -= step * error / np.sqrt(seen_bias)
            seen[ids] += shares**2 * np.mean(back**2)
            table[ids] = picked - (step * shares / np.sqrt(seen[ids]))[:, None] * back
    return QualityModel((table @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0]))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of the rows that may be learned from: crc32 of the id as text, modulo 5, is not 0.

    NULL ids and labels and ids with contradicting labels teach nothing.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return known.filter("quality = most").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "quality")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled documents of each class, whole texts; rows are weighted back to the class shares."""
    known = freeze(training_labels(labels), "labels")
    totals = {row.quality: row["count"] for row in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    chosen = freeze(chosen[0].union(chosen[1]), "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = document_features(batch.column("text"))
        packed = [pa.array([part.astype(kind).tobytes() for part in parts], pa.binary()) for parts, kind in zip(zip(*found, strict=True), ("<u2", "<f4"), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *packed], ["doc_id", "quality", "ids", "shares"])

    # Feature numbers fit two bytes. The rows stay where Arrow put them: a sorted copy would double the driver's share.
    described = map_text(texts.select("doc_id", "quality", "text"), describe, "doc_id bigint, quality int, ids binary, shares binary")
    table = described.toArrow()
    quality = table["quality"].to_numpy()
    share = {q: totals[q] / max(int((quality == q).sum()), 1) for q in totals}
    scale = sum(totals.values()) / max(len(quality), 1)
    ids, shares = ([np.frombuffer(value.as_buffer(), kind) for value in table[name]] for name, kind in (("ids", "<u2"), ("shares", "<f4")))
    rows = [(ids[i], shares[i], int(quality[i]), share[quality[i]] / scale) for i in np.argsort(table["doc_id"].to_numpy(), kind="stable")]
    model = fit(rows)
    del rows, ids, shares, table
    pa.default_memory_pool().release_unused()  # the driver lives on
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``. NULL and blank texts have no token: their score is the intercept's.

    The text is the only input. A column of that name is replaced; other columns pass through.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.intercept))  # one number per feature, a fixed size
    docs = docs.drop("quality_score").withColumn("text", F.col("text").cast("string"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("quality_score", pa.array(QualityModel(*shared.value).scores(batch.column("text"))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", quality_score double"
    return map_text(docs, run, schema)
