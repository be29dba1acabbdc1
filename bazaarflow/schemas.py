"""Declared table schemas and the fixed vocabularies of the domain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------------------------
RAW_COLUMNS = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country")
SPLIT_NAMES = ("train", "val", "test")
HORIZONS = (30, 60, 90)
LOOKBACKS = (60, 90, 120)
WINDOWS = (30, 60, 90, 120)
LABEL_METRICS = ("net_revenue", "purchase")
LABEL_NAMES = tuple(f"{metric}_{days}d" for days in HORIZONS for metric in LABEL_METRICS)
PROPENSITY_MODELS = ("logistic_regression", "boosted_trees")
RETRIEVERS = ("popularity", "mf", "learned")
POLICIES = (
    ("ml_top_expected_value", "expected_value_score"),
    ("random_baseline", "random_policy_score"),
    ("rfm_heuristic", "rfm_policy_score"),
)
NO_PURCHASE_RECENCY = 9999
UNKNOWN_COUNTRY = "UNKNOWN"
BAD_TIMESTAMP_LIMIT = 0.01
SPEND_CAP_QUANTILE = 0.99
EVALUATION_K = 20
SNAPSHOT_COUNT = 12
# ------------------------------------------------------------------------------------------------------------------

# Line revenue is kept to four decimals, so money is summed exactly as whole ticks of 0.0001.
TICKS_PER_UNIT = 10000

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("invoice_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("item_description", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("line_revenue", T.DoubleType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

SPLIT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("user_id", "item_id", "invoice_id", "event_ts", "event_date", "split")
    ]
)

FEATURE_COLUMNS = (
    "recency_days",
    *(f"frequency_{days}d" for days in WINDOWS),
    *(f"monetary_{days}d" for days in WINDOWS),
    *(f"avg_basket_value_{days}d" for days in LOOKBACKS),
    "country",
)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required names that ``df`` does not have, sorted."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], table: str) -> DataFrame:
    """Return ``df`` unchanged, or fail when a required column is absent."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"the {table} lacks {missing}")
    return df


def check_windows(horizon: int | None = None, lookback: int | None = None) -> None:
    """Reject prediction horizons and feature lookbacks that the gold tables do not carry."""
    if horizon is not None and horizon not in HORIZONS:
        raise ValueError(f"prediction horizon must be one of {HORIZONS}, got {horizon}")
    if lookback is not None and lookback not in LOOKBACKS:
        raise ValueError(f"feature lookback must be one of {LOOKBACKS}, got {lookback}")
