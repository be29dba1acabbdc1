"""Corpus pipeline: reject poor documents, drop repeated lines and near copies, mix sources, tokenize.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last returns the encoded
documents. ``run`` writes every stage as Parquet in the shared checkpoint folder and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.llm import cube_mix, line_dedup, minhash, quality, unigram
from bazaarflow.llm.common import attach, freeze, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels as ``quality.train`` says."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("quality_score") >= quality.THRESHOLD).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line in whatever case go, and documents that lose all of their lines; ``n_chars`` follows the text."""
    left = line_dedup.line_dedup(docs, fold_case=True).filter((F.size("removed") == 0) | (F.size("removed") < F.col("n_lines")))
    columns = [F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    dropped = freeze(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "dropped")
    return attach(docs, dropped, "doc_id", "left_anti").select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    taken = freeze(cube_mix.mixed(docs).groupBy("equal_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "copies")
    keyed = docs.withColumn("equal_key", cube_mix.row_identity())
    if not taken.filter("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["equal_key"])  # equal rows are taken through one of them
    drawn = attach(keyed, taken.filter("copies > 0").select("equal_key", "copies"), "equal_key")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that they decode to the text."""
    return unigram.encoded(docs, unigram.Vocabulary.load())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", encode_stage),
]
# SQL cannot express a trained classifier, a balanced sample or a Viterbi path.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
