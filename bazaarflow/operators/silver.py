"""Silver: raw text lines to one clean row per (invoice, item, timestamp)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.columns import blank_to_null, normalize_user_id, parse_number, parse_timestamp, round_half_away
from bazaarflow.schemas import RAW_COLUMNS, SILVER_SCHEMA, require_columns

GRAIN = ("invoice_id", "item_id", "event_ts")


def raw_dedup(raw: DataFrame) -> DataFrame:
    """Drop exact duplicates over the eight source columns.

    Numbers, timestamps and the user id are parsed first so that ``1`` and ``1.0`` are one value; the other text
    columns are compared untrimmed. Distinct is combined before the shuffle, so a flood of copies costs one row per task.
    """
    require_columns(raw, RAW_COLUMNS, "raw source")
    return raw.select(
        "Invoice",
        "StockCode",
        "Description",
        parse_number(F.col("Quantity")).alias("Quantity"),
        parse_timestamp(F.col("InvoiceDate")).alias("InvoiceDate"),
        parse_number(F.col("Price")).alias("Price"),
        normalize_user_id(F.col("Customer ID")).alias("Customer ID"),
        "Country",
    ).distinct()


def typed_lines(raw: DataFrame) -> DataFrame:
    """Trimmed ids and text, parsed numbers and timestamps; what cannot be parsed is NULL. No row is dropped.

    Takes raw text or the output of :func:`raw_dedup`.
    """
    is_text = {f.name: f.dataType.typeName() == "string" for f in raw.schema}

    def parsed(name: str, parse: Callable[[Column], Column]) -> Column:
        return parse(F.col(name)) if is_text[name] else F.col(name)

    return raw.select(
        F.trim("Invoice").alias("invoice_id"),
        F.trim("StockCode").alias("item_id"),
        blank_to_null(F.col("Description")).alias("item_description"),
        parsed("Quantity", parse_number).alias("quantity"),
        parsed("InvoiceDate", parse_timestamp).alias("event_ts"),
        parsed("Price", parse_number).alias("unit_price"),
        F.trim("Customer ID").alias("user_id"),
        F.trim("Country").alias("country"),
    )


def normalize_users(typed: DataFrame) -> DataFrame:
    """Numeric-looking user ids without their trailing ``.0``."""
    return typed.withColumn("user_id", normalize_user_id(F.col("user_id")))


def valid_lines(typed: DataFrame) -> DataFrame:
    """Rows with ids, a timestamp, a non-zero quantity and a non-negative price. A missing user is allowed."""
    return normalize_users(typed).filter(
        (F.col("invoice_id") != "")
        & (F.col("item_id") != "")
        & F.col("event_ts").isNotNull()
        & F.col("quantity").isNotNull()
        & (F.col("quantity") != 0)
        & F.col("unit_price").isNotNull()
        & (F.col("unit_price") >= 0)
    )


def _exact_sum(amount: Column) -> Column:
    """``sum(cast(amount as decimal(38,8)))`` as a double, without a decimal for most rows.

    Below a million, an amount times 10**8 is off by less than 0.03, so one that lies within 0.25 of a whole number has
    that number of units of 10**-8. Units are added up as whole millions of millions and rest; what is left is added up as
    decimals.
    """
    units = F.rint(amount * F.lit(1e8))
    near = (F.abs(amount) < 1e6) & (F.abs(amount * F.lit(1e8) - units) < 0.25)
    whole = F.when(near, units.cast("bigint"))
    rest = F.sum(F.when(~near, amount.cast("decimal(38,8)")))
    low = F.sum(whole % 1_000_000_000_000)
    high = F.sum((whole - whole % 1_000_000_000_000) / F.lit(1e12)).cast("bigint")
    # Up to 2**52 units the division rounds as the decimal does.
    few = rest.isNull() & (F.abs(high) < 4_000) & (F.abs(low) < 10**14)
    unit = F.lit("0.00000001").cast("decimal(8,8)")
    units_of = (high.cast("decimal(20,0)") * F.lit(10_000) + low.cast("decimal(20,0)") * unit).cast("decimal(36,8)")
    # One digit less, so that adding the two keeps all eight decimals.
    both = units_of + rest.cast("decimal(37,8)")
    in_all = F.when(high.isNull(), rest).when(rest.isNull(), units_of).otherwise(both)
    return F.when(few, (high * 1_000_000_000_000 + low).cast("double") / F.lit(1e8)).otherwise(in_all.cast("double"))


def silver_grain_agg(valid: DataFrame) -> DataFrame:
    """One row per (invoice, item, timestamp): net quantity, mean price, net revenue, and the largest text values.

    Quantities and revenues are summed exactly at eight decimals, so the sums do not depend on how rows are spread over tasks.
    """
    return valid.groupBy(*GRAIN).agg(
        F.max("item_description").alias("item_description"),
        # A cast alone would truncate; quantities are rounded to the nearest whole number.
        F.rint(_exact_sum(F.col("quantity"))).cast("int").alias("quantity"),
        round_half_away(F.avg("unit_price"), 4).alias("unit_price"),
        round_half_away(_exact_sum(F.col("quantity") * F.col("unit_price")), 4).alias("line_revenue"),
        F.max(blank_to_null(F.col("user_id"))).alias("user_id"),
        F.max(blank_to_null(F.col("country"))).alias("country"),
    )


def silver_transactions(raw: DataFrame) -> DataFrame:
    """The silver table: deduplicated, typed, validated, aggregated to the grain, rows that net to zero removed."""
    grain = silver_grain_agg(valid_lines(typed_lines(raw_dedup(raw))))
    return (
        grain.filter(F.col("quantity") != 0)
        .withColumn("event_date", F.to_date("event_ts"))
        .select(*SILVER_SCHEMA.fieldNames())
    )


def silver_event_bounds(silver: DataFrame) -> DataFrame:
    """First and last event date, one row; NULLs when the table is empty (see :func:`require_event_bounds`)."""
    return silver.agg(F.min("event_date").alias("min_event_date"), F.max("event_date").alias("max_event_date"))


def require_event_bounds(silver: DataFrame) -> tuple:
    """The bounds as two dates; an empty table is an error."""
    low, high = silver_event_bounds(silver).first()
    if low is None:
        raise ValueError("silver has no usable event_date values, so gold tables cannot be built")
    return low, high
