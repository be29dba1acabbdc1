"""Token counts as delta-maintained rollups: signed changes, idempotent batch commits, additive totals.

A change says what a document counts under a tokenizer version from now on: ``insert`` or ``revise`` with a new count,
``delete`` without one. A batch is turned into signed deltas against the ledger (what each document counted last): the
old contribution with a minus, the new one with a plus. Totals by source, language and tokenizer version are the sums of
the deltas of all committed batches; texts are never read again, and the work of a batch follows the batch and the
ledger's ids, not the corpus's texts.

A batch is written in three steps: ledger rows, deltas, and last the commit row. Readers only see committed batches. A
batch that was cut off is written anew; one that is committed already is left alone, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.functions.scale import ensure_checkpoint_dir
from bazaarflow.llm.common import WORD

# Words; and words with every punctuation mark on its own.
TOKENIZERS: dict[str, str] = {"words-1": WORD, "pieces-1": r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x20\x09-\x0D]"}
LEDGER = "doc_id bigint, version string, source string, lang string, tokens bigint, live boolean"
DELTAS = "source string, lang string, version string, documents bigint, tokens bigint"


def counted(docs: DataFrame, version: str, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, version, source, lang, tokens, action``: every row of ``docs`` inserted under ``version``.

    ``tokens`` maps the text column to its count (a pandas UDF around a tokenizer, say); without it the version must be
    one of ``TOKENIZERS``. NULL and empty texts count 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = tokens(text) if tokens else F.regexp_count(text, F.lit(TOKENIZERS[version]))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.lit(version).alias("version"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        count.cast("bigint").alias("tokens"),
        F.lit("insert").alias("action"),
    )


def bpe_counter(path: str) -> Callable[[Column], Column]:
    """Counter for a tokenizers file at ``path``, which every executor must be able to read; Arrow batches, no row loop."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int64")

    return count


@dataclass
class TokenRollup:
    """The rollup under ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str

    def _read(self, part: str, schema: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/{part}/{batch}" for batch in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def committed(self) -> list[str]:
        """Ids of the committed batches in commit order: one small row per batch."""
        try:
            rows = self.spark.read.schema("batch string, number bigint").parquet(f"{self.root}/commits/*")
            return [row.batch for row in rows.orderBy("number").collect()]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []

    def ledger(self) -> DataFrame:
        """What every document counts now under each version; deleted ones have ``live`` false."""
        batches = self.committed()
        numbered = [self._read("ledger", LEDGER, [batch]).withColumn("number", F.lit(i)) for i, batch in enumerate(batches)]
        if not numbered:
            return self.spark.createDataFrame([], LEDGER)
        last = F.max_by(F.struct("source", "lang", "tokens", "live"), "number").alias("last")
        return reduce(DataFrame.unionByName, numbered).groupBy("doc_id", "version").agg(last).select("doc_id", "version", "last.*")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, source, lang, tokens, action, optionally ``seq``) once; False if it was.

        Of several changes of one document and version in a batch the one with the greatest ``seq`` holds, among equal
        ones the greatest by action, source, lang and tokens; rows that are equal count once. An insert of a known
        document is a revision, a revision of an unknown one an insert, a delete of an unknown one nothing. NULL ids,
        sources and languages are values like any other. Other columns are ignored.
        """
        batches = self.committed()
        if batch in batches:
            return False
        unknown = changes.filter(~F.col("action").isin("insert", "revise", "delete") | F.col("action").isNull())
        if not unknown.isEmpty():
            raise ValueError("an action is insert, revise or delete")
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0).cast("bigint")
        row = F.struct(seq.alias("seq"), "action", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))
        wanted = changes.select(F.col("doc_id").cast("bigint").alias("doc_id"), "version", row.alias("new"), F.lit(None).cast("struct<source:string,lang:string,tokens:bigint>").alias("old"))
        known = self.ledger().filter("live").select(
            "doc_id", "version", F.lit(None).cast(wanted.schema["new"].dataType).alias("new"), F.struct("source", "lang", "tokens").alias("old")
        )
        # One grouping instead of an outer join: it also matches NULL ids.
        met = wanted.unionByName(known).groupBy("doc_id", "version").agg(F.max("new").alias("new"), F.max("old").alias("old")).filter("new is not null")
        stays = F.col("new.action") != "delete"
        ledger = met.select("doc_id", "version", "new.source", "new.lang", F.when(stays, F.col("new.tokens")).otherwise(0).alias("tokens"), stays.alias("live"), "old")
        ledger.filter(F.col("live") | F.col("old").isNotNull()).write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER + ", old struct<source:string,lang:string,tokens:bigint>").parquet(f"{self.root}/ledger/{batch}")

        def signed(sign: int, source: str, lang: str, tokens: str) -> Column:
            return F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(sign).cast("bigint").alias("documents"), (F.col(tokens) * sign).alias("tokens"))

        plus = F.when(F.col("live"), F.array(signed(1, "source", "lang", "tokens"))).otherwise(F.array())
        minus = F.when(F.col("old").isNotNull(), F.array(signed(-1, "old.source", "old.lang", "old.tokens"))).otherwise(F.array())
        deltas = written.select("version", F.inline(F.concat(plus, minus))).groupBy("source", "lang", "version")
        deltas.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        commit = self.spark.createDataFrame([(batch, len(batches))], "batch string, number bigint").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens`` of the groups that hold documents."""
        deltas = self._read("deltas", DELTAS, self.committed())
        sums = deltas.groupBy("source", "lang", "version").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 or tokens <> 0")


def shared_root(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm/{name}"
