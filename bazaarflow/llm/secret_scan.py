"""Secret scans with corpus-wide ownership frequency, on DataFrame functions only.

Base candidates are three patterns: assignments of a credential word, access keys, long hexadecimal runs. A fourth,
``loose``, takes long runs of key characters that mix digits, small and capital letters and touch no base span.

Every candidate value is hashed and counted over the whole corpus by distinct owners and distinct repositories that hold
it. A value held by more than ``COPIED_OWNERS`` owners is a widely copied example; the others are specific to their
owners and look live. Base spans are always reported, with their class; a loose candidate becomes a span only if its
value is specific to its owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.llm.common import attach, freeze, text_key

# --- fixed values: the base patterns and their least lengths ---
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 6
# A match takes a whole run of its class, so asking for the length in the pattern finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# --- end of fixed values ---
LOOSE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "loose")
COPIED_OWNERS = 2
FOUND = "array<struct<kind:int,start:int,end:int,value:string>>"


def _found(kind: str, pattern: str) -> Column:
    """Matches of ``pattern`` in ``text``: kind, start, end (code points) and the candidate value.

    Places come from the text between the matches: match ``i`` starts after ``i + 1`` gaps and ``i`` matches.
    """
    text, whole = F.col("text"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("match"), F.slice(gaps, 1, F.size(whole)).alias("gap"), value.alias("value"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    found = F.aggregate(parts, nothing, step, lambda state: state["found"])
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast(FOUND))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def candidates(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``base`` and ``loose``: arrays of kind, start, end, value."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).select(
        *rest,
        F.filter(_found("assign", ASSIGN), lambda s: F.length(s["value"]) >= ASSIGN_LENGTH).alias("_assign"),
        _found("access", ACCESS).alias("_access"),
        _found("hex", HEX).alias("_hex"),
        _found("loose", LOOSE).alias("_loose"),
    )
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    based = found.select(*rest, F.concat("_assign", "_access", "_hex").alias("base"), F.filter("_loose", lambda s: mixed(s["value"])).alias("_loose"))
    apart = F.filter("_loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return based.select(*rest, "base", F.when(F.size("_loose") > 0, apart).otherwise(F.col("_loose")).alias("loose"))


def value_owners(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """``v1, v2, owners, repositories``: how many distinct owners and repositories hold each candidate value.

    A NULL owner or repository counts as one of its own. Two steps of grouping keep a value that everybody copies from
    meeting in one task: its rows are combined before each shuffle.
    """
    values = found.select(
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.explode(F.concat("base", "loose")).alias("c"),
    )
    hashed = values.select("owner", "repository", F.xxhash64("c.value").alias("v1"), F.xxhash64(F.lit("second"), "c.value").alias("v2"))
    inside = hashed.groupBy("v1", "v2", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    by_owner = inside.groupBy("v1", "v2", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``doc_id, base, spans, n_live, n_copied`` for every row of ``docs`` (doc_id, text, owner, repository).

    ``base`` and ``spans`` are arrays of kind, start, end, value; ``n_live`` and ``n_copied`` count the spans whose value
    is specific to its owners or widely copied. NULL and empty texts have no spans. Rows that repeat a doc_id and text
    count as one repository and each return the same. Other columns are ignored.
    """
    rows = docs.select(
        "doc_id", F.col(owner).alias("_owner"), F.col(repository).alias("_repository"), *text_key(F.col("text").cast("string")), "text"
    )
    scanned = freeze(candidates(rows), "candidates")
    some = scanned.filter((F.size("base") > 0) | (F.size("loose") > 0))
    owners = freeze(value_owners(some, "_owner", "_repository"), "owners")
    each = some.dropDuplicates(["doc_id", "_t1", "_t2"]).select("doc_id", "_t1", "_t2", F.explode(F.concat("base", "loose")).alias("c"))
    each = each.withColumn("v1", F.xxhash64("c.value")).withColumn("v2", F.xxhash64(F.lit("second"), "c.value"))
    live = F.col("owners") <= COPIED_OWNERS
    judged = attach(each, owners, ["v1", "v2"]).filter(live | (F.col("c.kind") < KINDS.index("loose")))
    spans = judged.groupBy("doc_id", "_t1", "_t2").agg(
        F.collect_list("c").alias("spans"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied")
    )
    spans = freeze(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("_t1", "_s1").withColumnRenamed("_t2", "_s2"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_s1")) & (F.col("_t2") == F.col("_s2"))
    none, zero = F.array().cast(FOUND), F.lit(0).cast("bigint")
    return scanned.join(spans, same, "left").select(
        "doc_id", "base", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``secret_spans``: counts by kind, the digest of the base spans, all spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )
