"""Readers: raw CSV, parquet tables, the snapshot panel, and the adapter from the order tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.functions.scale import shuffled
from bazaarflow.schemas import RAW_COLUMNS, RAW_SCHEMA, require_columns


def raw_csv_source(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns, quotes doubled as the CSV standard has it. Typing is the silver step's work.

    A quoted field may hold line ends, so a file is read by one task: deliver large extracts as many files. A row with
    too few or too many fields fails the read. An empty field is NULL, a quoted empty one the empty text.
    """
    options = {"header": True, "multiLine": True, "enforceSchema": False, "escape": '"', "nullValue": "\x00", "mode": "FAILFAST"}
    reader = spark.read.options(**options)
    header = reader.csv(path).columns if path else []
    missing = sorted(set(RAW_COLUMNS) - set(header))
    if missing:
        raise ValueError(f"the raw file lacks {missing}")
    if tuple(header) == RAW_COLUMNS:
        return reader.schema(RAW_SCHEMA).csv(path)
    return reader.csv(path).select(*(F.col(f"`{name}`") for name in RAW_COLUMNS))


def parquet_source(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """A parquet table; a missing path or a missing column is an error."""
    return require_columns(spark.read.parquet(path), required, path)


def read_panel(spark: SparkSession, root: str, dates: Iterable[str], allow_empty: bool = False) -> DataFrame:
    """Rows of the wanted ``as_of_date`` partitions; the filter prunes the other folders before any file is read."""
    wanted = sorted({str(date) for date in dates})
    if not wanted:
        raise ValueError("name the snapshot dates to read")
    panel = spark.read.parquet(root).filter(F.col("as_of_date").isin([F.lit(d).cast("date") for d in wanted]))
    if not allow_empty and panel.isEmpty():
        raise ValueError(f"{root} holds no snapshot of {', '.join(wanted)}")
    return panel


# Columns read from the order tables. Declared, so that planning does not open a file.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def required_columns(name: str) -> list[str]:
    """Columns of an order table that the adapter reads."""
    return [part.split()[0] for part in TABLE_SCHEMAS[name].split(", ")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight raw text columns, built from the order tables. A returned line has a negative quantity.

    Lines, orders, customers and parts all grow with the data, so they meet in shuffled merge joins, which spill and whose
    hot keys adaptive execution can split. The join with the few nations is left to the optimizer.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    parts = table(spark, sf_dir, "part")
    buyers = orders.join(
        shuffled(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))), F.col("o_custkey") == F.col("c_custkey")
    )
    joined = lines.join(shuffled(buyers), F.col("l_orderkey") == F.col("o_orderkey")).join(
        shuffled(parts), F.col("l_partkey") == F.col("p_partkey")
    )
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    # floor(x + 0.5) is the same arithmetic in every engine, unlike the tie rules of round().
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000 + 0.5).cast("double") / 10000
    return joined.select(
        F.col("o_orderkey").cast("string").alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        signed.cast("string").alias("Quantity"),
        F.col("o_orderdate").cast("string").alias("InvoiceDate"),
        price.cast("string").alias("Price"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("Customer ID"),
        F.col("n_name").alias("Country"),
    )
