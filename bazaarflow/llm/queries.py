"""One query per operator over the given tables, each as thin as its contract."""

from __future__ import annotations

from collections.abc import Callable

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import cube_mix, iblt, line_dedup, merkle, minhash, permutation_index, quality, secret_scan, spelling, substring_dedup, suffix_dedup, token_rollup, unigram
from bazaarflow.llm.common import freeze, read_table, text_key

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches over all documents: inserts under two tokenizer versions; revised counts, the words of repeated texts'
    first copies counted with the punctuation; deletes of the repeated copies, sent twice."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark, token_rollup.shared_root(spark, f"rollup-{uuid4()}"))
    words, pieces = token_rollup.TOKENIZERS
    for version in (words, pieces):
        rollup.commit(f"insert-{version}", token_rollup.counted(docs, version))
    keyed = docs.select("doc_id", *text_key(F.col("text")))
    groups = keyed.groupBy("_t1", "_t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    copies = freeze(keyed.join(groups, ["_t1", "_t2"]).select("doc_id", "first"), "copies")
    known = rollup.ledger()
    other = known.filter(F.col("version") == pieces).select("doc_id", F.col("tokens").alias("recounted"))
    heads = copies.filter("doc_id = first").select("doc_id")
    revised = known.filter(F.col("version") == words).join(heads, "doc_id").join(other, "doc_id")
    rollup.commit("revise", revised.select("doc_id", "version", "source", "lang", F.col("recounted").alias("tokens"), F.lit("revise").alias("action")))
    gone = known.join(copies.filter("doc_id <> first").select("doc_id"), "doc_id").select("doc_id", "version", "source", "lang", "tokens", F.lit("delete").alias("action"))
    for _ in range(2):
        rollup.commit("delete", gone)
    return rollup.totals()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.encoded(docs, unigram.Vocabulary.load())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return cube_mix.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, fold_case=True).select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, cut = substring_dedup.repeated_passages(docs)
    # Rows that repeat a doc_id lose the same words.
    changed = cut.select("doc_id", "n_removed", F.col("kept_sha256").alias("left_sha256")).dropDuplicates(["doc_id"])
    return rows.join(freeze(changed, "changed"), "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    # An id that is NULL counts as the empty text.
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return secret_scan.digest(secret_scan.secret_spans(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(*suffix_dedup.repeated_strings(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.merkle_manifest(docs, tampered).select(
        "doc_id",
        *(merkle.hex_text(F.col(name)).alias(name) for name in ("leaf", "subroot", "root")),
        F.sha2(merkle.hex_text(F.col("proof")), 256).alias("proof_sha256"),
        merkle.hex_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def all_queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_mix_sources": op3_mix_sources,
        "op4_line_dedup": op4_line_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_ann_search": op6_ann_search,
        "op9_quality": op9_quality,
        "op7_fingerprints": op7_fingerprints,
        "op8_substring_dedup": op8_substring_dedup,
        "op10_secret_scan": op10_secret_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
