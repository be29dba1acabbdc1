"""Preparation of the panel for modelling."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarflow.functions.scale import exact_quantile, with_ordinal
from bazaarflow.schemas import SNAPSHOT_COUNT, SPEND_CAP_QUANTILE, check_windows, require_columns

# Rank error of the sketched quantile: one part in so many rows.
SKETCH_ACCURACY = 10_000
BROADCAST_COUNTRIES = 100_000
SLICES = ("train", "validation", "test")


class OneClassError(ValueError):
    """All labels are equal, so nothing can be learned."""


def numeric_features(lookback: int) -> list[str]:
    """Model inputs for one lookback, in their frozen order. The 30-day pair is always present."""
    return [
        "recency_days",
        "frequency_30d",
        "monetary_30d",
        f"frequency_{lookback}d",
        f"monetary_{lookback}d",
        f"avg_basket_value_{lookback}d",
    ]


def training_rows(panel: DataFrame, horizon: int, lookback: int) -> DataFrame:
    """Typed model inputs with the purchase and revenue labels of one horizon."""
    check_windows(horizon, lookback)
    inputs = numeric_features(lookback)
    purchase, revenue = f"label_purchase_{horizon}d", f"label_net_revenue_{horizon}d"
    require_columns(panel, ["user_id", "as_of_date", "country", purchase, revenue, *inputs], "snapshot panel")
    return panel.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("as_of_date").cast("string").alias("as_of_date"),
        F.col("country").cast("string").alias("country"),
        *(F.col(name).cast("double").alias(name) for name in inputs),
        F.col(purchase).cast("double").alias("purchase_label"),
        F.col(revenue).cast("double").alias("revenue_label"),
    )


def split_10_1_1(rows: DataFrame, date_col: str = "as_of_date") -> DataFrame:
    """Add ``slice``: the ten oldest of the twelve snapshots train, the eleventh validation, the twelfth test.

    At most thirteen dates reach the driver; the slices are then plain comparisons, no join.
    """
    dates = sorted(row[0] for row in rows.select(date_col).distinct().limit(SNAPSHOT_COUNT + 1).collect())
    if len(dates) != SNAPSHOT_COUNT:
        found = f"more than {SNAPSHOT_COUNT}" if len(dates) > SNAPSHOT_COUNT else str(len(dates))
        raise ValueError(f"the panel must hold {SNAPSHOT_COUNT} snapshots to be split, it holds {found}")
    day = F.col(date_col)
    name = F.when(day == F.lit(dates[-1]), "test").when(day == F.lit(dates[-2]), "validation").otherwise("train")
    return rows.withColumn("slice", name)


def label_class_check(train: DataFrame, label: str = "purchase_label") -> DataFrame:
    """Rows per class are enough: training needs both classes."""
    counted = train.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    classes = counted.agg(F.count(F.lit(1)).alias("class_count"))
    return classes.withColumn("passed", F.col("class_count") >= 2)


def require_two_classes(train: DataFrame, label: str = "purchase_label") -> None:
    if not label_class_check(train, label).first()["passed"]:
        raise OneClassError("the training slice has no contrast: every label is the same")


def spend_cap_value(train: DataFrame, lookback: int, q: float = SPEND_CAP_QUANTILE) -> DataFrame:
    """One-row table with the interpolated spend quantile of the training rows."""
    return exact_quantile(train, f"monetary_{lookback}d", q, "spend_cap_value")


def spend_cap_sketch(
    train: DataFrame, lookback: int, q: float = SPEND_CAP_QUANTILE, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """The spend quantile in one pass without a sort: a value of the rows whose rank is off by at most rows / accuracy.

    Sketches of the tasks are merged, so the shuffle carries one sketch per task. NULL when there are no values.
    """
    return train.agg(F.percentile_approx(f"monetary_{lookback}d", q, accuracy).alias("spend_cap_value"))


def apply_spend_cap(rows: DataFrame, lookback: int, cap: float | Column) -> DataFrame:
    """Limit the long-window spend to the frozen training value."""
    name = f"monetary_{lookback}d"
    limit = cap if isinstance(cap, Column) else F.lit(float(cap))
    return rows.withColumn(name, F.least(F.col(name), limit))


def country_one_hot(train: DataFrame, rows: DataFrame) -> DataFrame:
    """One 0/1 column per training country, in name order; a country not seen in training is all zeros.

    The country list is a small closed vocabulary; it defines the columns, so the driver has to know it.
    """
    countries = [row[0] for row in train.select("country").distinct().orderBy("country").collect() if row[0] is not None]
    flags = [(F.col("country").eqNullSafe(F.lit(name))).cast("double").alias(f"country_{name}") for name in countries]
    return rows.select(*(c for c in rows.columns if c != "country"), *flags)


def country_vocabulary(train: DataFrame) -> tuple[DataFrame, int]:
    """Each training country with its slot in name order (``country``, ``country_slot``), frozen; and their number."""
    names = train.filter(F.col("country").isNotNull()).select("country").distinct()
    return with_ordinal(names, ["country"], "country_slot")


def country_vectors(rows: DataFrame, vocabulary: DataFrame, size: int, output: str = "country_flags") -> DataFrame:
    """The 0/1 flags of ``country_one_hot`` as one sparse vector of ``size`` slots, for vocabularies of any length.

    A country outside the vocabulary, or none, has an empty vector. The vocabulary stays a table: it is copied to the
    executors up to ``BROADCAST_COUNTRIES`` rows and beyond that met in a join whose hot keys adaptive execution splits.
    """
    if size < 1:
        raise ValueError("the training rows name no country")
    slots = F.broadcast(vocabulary) if size <= BROADCAST_COUNTRIES else vocabulary  # counted: at most so many names
    placed = rows.join(slots, "country", "left").withColumn("country_slot", F.coalesce("country_slot", F.lit(size)))
    # Fitting takes the largest slot only; with "keep" the slot after it stands for the unknown and is left out.
    encoder = OneHotEncoder(inputCol="country_slot", outputCol=output, handleInvalid="keep", dropLast=True)
    return encoder.fit(vocabulary).transform(placed).drop("country", "country_slot")


def feature_assembly(lookback: int, output: str = "features") -> Pipeline:
    """Numeric inputs followed by the country flags as one vector; unseen countries fall into the dropped slot."""
    index = StringIndexer(
        inputCol="country", outputCol="country_index", handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    flags = OneHotEncoder(inputCols=["country_index"], outputCols=["country_flags"], dropLast=True)
    assemble = VectorAssembler(inputCols=[*numeric_features(lookback), "country_flags"], outputCol=output)
    return Pipeline(stages=[index, flags, assemble])
