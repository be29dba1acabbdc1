"""Propensity and conditional-revenue models on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarflow.operators.policy import expected_value_score
from bazaarflow.operators.prep import OneClassError, apply_spend_cap, feature_assembly, numeric_features
from bazaarflow.schemas import PROPENSITY_MODELS, require_columns

SEED = 42
FOLDS = 3


def with_class_weights(rows: DataFrame, label: str = "purchase_label") -> tuple[DataFrame, float]:
    """Balance the classes: n / (2 * rows of the class). The weights add up to n, which is returned too."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    ).first()
    if not counts["pos"] or not counts["neg"]:
        raise OneClassError("one of the two classes is missing from the training rows")
    weight = F.when(F.col(label) == 1, counts["n"] / (2.0 * counts["pos"])).otherwise(counts["n"] / (2.0 * counts["neg"]))
    return rows.withColumn("class_weight", weight), float(counts["n"])


def scaled_assembly(rows: DataFrame, lookback: int) -> list:
    """Stages that divide every input and country flag by its sample deviation on ``rows`` and collect them in ``features``.

    The divisions are plain SQL columns, so a fitted pipeline holds numbers only. An input without spread becomes 0. The
    countries are a small closed vocabulary.
    """
    countries = [r[0] for r in rows.select("country").distinct().orderBy("country").collect() if r[0] is not None]
    quoted = [name.replace("\\", "\\\\").replace("'", "\\'") for name in countries]
    inputs = [f"`{name}`" for name in numeric_features(lookback)] + [f"CAST(country <=> '{name}' AS DOUBLE)" for name in quoted]
    spread = rows.agg(*(F.stddev_samp(F.expr(text)).alias(f"s{i}") for i, text in enumerate(inputs))).first()
    scaled = [f"{text} / {float(s)!r}D AS scaled_{i}" if s else f"0.0D AS scaled_{i}" for i, (text, s) in enumerate(zip(inputs, spread, strict=True))]
    names = [f"scaled_{i}" for i in range(len(inputs))]
    return [SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"), VectorAssembler(inputCols=names, outputCol="features")]


def _scoring_stages(model: LogisticRegressionModel) -> list:
    """The fitted model as plain SQL over the scaled inputs, with its usual ``rawPrediction`` and ``probability``.

    A freshly fitted model also holds its training summary and with it the session, which cannot be sent to tasks once
    the session has observed a query; its numbers are all that scoring needs.
    """
    terms = [f"{float(c)!r}D * scaled_{i}" for i, c in enumerate(model.coefficients.toArray())]
    margin = " + ".join([f"{float(model.intercept)!r}D", *terms])
    chance = "1.0D / (1.0D + exp(-margin))"
    return [
        SQLTransformer(statement=f"SELECT *, {margin} AS margin FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, -margin AS against, 1.0D - {chance} AS chance_0, {chance} AS chance_1 FROM __THIS__"),
        VectorAssembler(inputCols=["against", "margin"], outputCol="rawPrediction"),
        VectorAssembler(inputCols=["chance_0", "chance_1"], outputCol="probability"),
    ]


def propensity_logistic(train: DataFrame, lookback: int, max_iter: int = 2000) -> PipelineModel:
    """Class-balanced logistic regression on scaled inputs; unit L2 strength, expressed per unit of total weight."""
    rows, n = with_class_weights(train)
    fit = LogisticRegression(
        featuresCol="features",
        labelCol="purchase_label",
        weightCol="class_weight",
        regParam=1.0 / n,
        standardization=False,
        maxIter=max_iter,
    )
    scaling = scaled_assembly(rows, lookback)
    fitted = Pipeline(stages=[*scaling, fit]).fit(rows).stages[-1]
    return PipelineModel([*scaling, *_scoring_stages(fitted)])


def propensity_gbt(train: DataFrame, lookback: int, max_iter: int = 300) -> PipelineModel:
    """Boosted trees of depth 4; each tree sees 90 % of the rows, each split 90 % of the inputs."""
    fit = GBTClassifier(
        featuresCol="features",
        labelCol="purchase_label",
        maxIter=max_iter,
        maxDepth=4,
        stepSize=0.05,
        subsamplingRate=0.9,
        featureSubsetStrategy="0.9",
        seed=SEED,
    )
    return Pipeline(stages=[feature_assembly(lookback), fit]).fit(train)


def fit_base_model(name: str, train: DataFrame, lookback: int, max_iter: int | None = None) -> PipelineModel:
    if name not in PROPENSITY_MODELS:
        raise ValueError(f"there is no propensity model named {name}; known are {PROPENSITY_MODELS}")
    extra = {} if max_iter is None else {"max_iter": max_iter}
    return (propensity_logistic if name == "logistic_regression" else propensity_gbt)(train, lookback, **extra)


def _base_score(name: str) -> Column:
    """What calibration sees: the margin of the linear model, the probability of the trees."""
    return vector_to_array("rawPrediction" if name == "logistic_regression" else "probability")[1]


def fit_platt(held_out: DataFrame) -> LogisticRegressionModel:
    """Sigmoid through the held-out scores. Platt's smoothed targets become a weighted pair of rows per example."""
    counts = held_out.agg(F.count_if(F.col("purchase_label") == 1).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = counts["pos"], counts["n"] - counts["pos"]
    target = F.when(F.col("purchase_label") == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    halves = F.array(
        F.struct(F.lit(1.0).alias("target"), target.alias("share")),
        F.struct(F.lit(0.0).alias("target"), (F.lit(1.0) - target).alias("share")),
    )
    rows = held_out.select("base_score", F.inline(halves))
    rows = VectorAssembler(inputCols=["base_score"], outputCol="score_vector").transform(rows)
    fit = LogisticRegression(featuresCol="score_vector", labelCol="target", weightCol="share", standardization=True)
    return fit.fit(rows)


@dataclass
class CalibratedPropensity:
    """Base models of the folds with their sigmoids; the score is the mean of the calibrated probabilities."""

    name: str
    lookback: int
    folds: list[tuple[PipelineModel, float, float]]

    def transform(self, rows: DataFrame, output: str = "propensity_score") -> DataFrame:
        kept = rows.columns
        current = rows
        for i, (base, slope, intercept) in enumerate(self.folds):
            scored = base.transform(current)
            margin = _base_score(self.name) * F.lit(slope) + F.lit(intercept)
            current = scored.select(*kept, *(f"_fold_{j}" for j in range(i)), (1 / (1 + F.exp(-margin))).alias(f"_fold_{i}"))
        mean = reduce(lambda a, b: a + b, (F.col(f"_fold_{i}") for i in range(len(self.folds)))) / len(self.folds)
        return current.select(*kept, mean.alias(output))

    def save(self, path: str) -> None:
        """Fold models as pipelines, sigmoids as a small table."""
        spark = SparkSession.getActiveSession()
        rows = [(i, self.name, self.lookback, s, b) for i, (_, s, b) in enumerate(self.folds)]
        schema = "fold int, model_name string, lookback int, slope double, intercept double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/sigmoids")
        for i, (base, _, _) in enumerate(self.folds):
            base.write().overwrite().save(f"{path}/fold_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CalibratedPropensity:
        rows = spark.read.parquet(f"{path}/sigmoids").orderBy("fold").collect()
        folds = [(PipelineModel.load(f"{path}/fold_{row.fold}"), row.slope, row.intercept) for row in rows]
        return cls(rows[0].model_name, rows[0].lookback, folds)


def side_by_side(spark: SparkSession, *fits: Callable[[], object]) -> list:
    """Results of fits that do not need each other: a fit's many small jobs leave cores idle, which the others' jobs use.

    All are waited for; the first failure in the order of ``fits`` is raised.
    """
    with ThreadPool(len(fits)) as pool:
        started = [pool.apply_async(inheritable_thread_target(spark)(fit)) for fit in fits]
        pool.close()
        pool.join()
    return [one.get() for one in started]


def fit_calibrated(
    fit_rows: DataFrame, model: str, lookback: int, folds: int = FOLDS, max_iter: int | None = None
) -> CalibratedPropensity:
    """Fit one base model per fold and calibrate it on the rows it has not seen. Folds are a hash of the row key.

    The folds' jobs are independent and run side by side, as a cross-validator's do.
    """
    placed = fit_rows.withColumn("fold", F.pmod(F.xxhash64("user_id", "as_of_date"), F.lit(folds))).persist()

    def fit_fold(i: int) -> tuple[PipelineModel, float, float]:
        base = fit_base_model(model, placed.filter(F.col("fold") != i), lookback, max_iter)
        held_out = base.transform(placed.filter(F.col("fold") == i))
        platt = fit_platt(held_out.select("purchase_label", _base_score(model).alias("base_score")))
        return base, float(platt.coefficients[0]), float(platt.intercept)

    try:
        with ThreadPool(folds) as pool:
            return CalibratedPropensity(model, lookback, pool.map(inheritable_thread_target(placed.sparkSession)(fit_fold), range(folds)))
    finally:
        placed.unpersist()


def calibrated_scores(
    fit_rows: DataFrame, score_rows: DataFrame, model: str, lookback: int, folds: int = FOLDS, max_iter: int | None = None
) -> DataFrame:
    """``score_rows`` with the calibrated purchase probability."""
    return fit_calibrated(fit_rows, model, lookback, folds, max_iter).transform(score_rows)


def revenue_fallback_mean(fit_rows: DataFrame) -> DataFrame:
    """Mean revenue of buyers, never below zero; NULL when there are none."""
    mean = F.avg(F.when(F.col("purchase_label") == 1, F.col("revenue_label")))
    return fit_rows.agg(F.when(mean.isNotNull(), F.greatest(mean, F.lit(0.0))).alias("revenue_fallback_value"))


@dataclass
class ConditionalRevenue:
    """Revenue expected from a buyer: boosted trees, or one constant when there are too few buyers."""

    name: str
    fallback: float
    model: PipelineModel | None

    def transform(self, rows: DataFrame, output: str = "predicted_conditional_revenue") -> DataFrame:
        if self.model is None:
            return rows.withColumn(output, F.lit(max(0.0, self.fallback)))
        scored = self.model.transform(rows)
        return scored.select(*rows.columns, F.greatest(F.col("prediction"), F.lit(0.0)).alias(output))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(self.name, self.fallback, self.model is not None)]
        table = spark.createDataFrame(row, "model_name string, fallback double, has_model boolean")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConditionalRevenue:
        row = spark.read.parquet(f"{path}/settings").first()
        model = PipelineModel.load(f"{path}/model") if row.has_model else None
        return cls(row.model_name, row.fallback, model)


def fit_conditional_revenue(
    fit_rows: DataFrame, lookback: int, model: str = "gbt", max_iter: int = 200
) -> ConditionalRevenue:
    """Fit on buyers. ``model`` is ``gbt`` or ``constant``; fewer than two buyers always give the constant."""
    if model not in ("gbt", "constant"):
        raise ValueError(f"there is no revenue model named {model}; known are gbt and constant")
    buyers = fit_rows.filter(F.col("purchase_label") == 1)
    summary = buyers.agg(F.count(F.lit(1)).alias("n"), F.avg("revenue_label").alias("mean")).first()
    if not summary["n"]:
        raise ValueError("revenue is learned from buyers, and the fit rows hold none")
    if model == "constant" or summary["n"] < 2:
        return ConditionalRevenue("constant", float(summary["mean"]), None)
    trees = GBTRegressor(
        featuresCol="features",
        labelCol="revenue_label",
        maxIter=max_iter,
        maxDepth=4,
        stepSize=0.05,
        subsamplingRate=0.9,
        featureSubsetStrategy="0.9",
        seed=SEED,
    )
    fitted = Pipeline(stages=[feature_assembly(lookback), trees]).fit(buyers)
    return ConditionalRevenue("gbt", float(summary["mean"]), fitted)


def conditional_revenue(
    fit_rows: DataFrame, score_rows: DataFrame, lookback: int, model: str = "gbt", max_iter: int = 200
) -> DataFrame:
    """``score_rows`` with the revenue expected if they buy, floored at zero."""
    return fit_conditional_revenue(fit_rows, lookback, model, max_iter).transform(score_rows)


def fit_validation_stage(rows: DataFrame, model: str, lookback: int, max_iter: int | None = None) -> DataFrame:
    """Fit on the train slice, score the validation slice."""
    fit_rows, score_rows = rows.filter("slice = 'train'"), rows.filter("slice = 'validation'")
    return calibrated_scores(fit_rows, score_rows, model, lookback, max_iter=max_iter)


def fit_test_stage(rows: DataFrame, model: str, lookback: int, max_iter: int | None = None) -> DataFrame:
    """Refit the chosen model on train and validation, score the test slice."""
    fit_rows, score_rows = rows.filter("slice <> 'test'"), rows.filter("slice = 'test'")
    return calibrated_scores(fit_rows, score_rows, model, lookback, max_iter=max_iter)


def batch_score_snapshot(
    features: DataFrame, propensity: CalibratedPropensity, revenue: ConditionalRevenue, cap: float, horizon: int
) -> DataFrame:
    """Serving scores of one feature snapshot with fitted models and the frozen spend cap."""
    lookback = propensity.lookback
    inputs = numeric_features(lookback)
    require_columns(features, ["user_id", "as_of_date", "country", *inputs], "input snapshot")
    if features.isEmpty():
        raise ValueError("the snapshot to score is empty")
    rows = features.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("as_of_date").cast("string").alias("as_of_date"),
        "country",
        *(F.col(name).cast("double").alias(name) for name in inputs),
    )
    name = f"predicted_conditional_revenue_{horizon}d"
    scored = revenue.transform(propensity.transform(apply_spend_cap(rows, lookback, cap)), name)
    return expected_value_score(scored, name).select(
        "user_id", "as_of_date", "propensity_score", name, "expected_value_score"
    )
