"""Regression models of Spark ML on wide frames, their importances and the placebo test. Folds are fitted by learners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalpanel.operators import evaluation

LEAST_ROWS = 20


def wide(features: DataFrame, names: list[str]) -> DataFrame:
    """One row a period, one column a feature."""
    return features.filter(F.col("feature").isin(names)).groupBy("period").pivot("feature", names).agg(F.first("value"))


def vectors(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(df.dropna(subset=names))


def _deviation(train: DataFrame) -> tuple[float, int]:
    row = train.agg(F.stddev_pop("y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if row["n"] < LEAST_ROWS:
        raise ValueError(f"{row['n']} training rows; at least {LEAST_ROWS} are needed")
    return row["s"] or 1.0, row["n"]


def ridge(train: DataFrame, alpha: float = 1.0):
    """Minimises RSS + alpha * |w|^2."""
    s, n = _deviation(train)
    return LinearRegression(labelCol="y", regParam=alpha * s / n, elasticNetParam=0.0, standardization=False, solver="normal").fit(train)


def lasso(train: DataFrame, alpha: float = 1e-4):
    """Minimises RSS / 2n + alpha * |w|."""
    _deviation(train)
    return LinearRegression(labelCol="y", regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-10).fit(train)


def elastic_net(train: DataFrame, alpha: float = 1e-4, ratio: float = 0.5):
    s, n = _deviation(train)
    s = s * (n / (n - 1)) ** 0.5
    lam = alpha * ratio + s * alpha * (1 - ratio)
    return LinearRegression(labelCol="y", regParam=lam, elasticNetParam=alpha * ratio / lam, standardization=False, maxIter=500, tol=1e-10).fit(train)


def random_forest(train: DataFrame, trees: int = 100, depth: int = 3, leaf: int = 10):
    _deviation(train)
    return RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(train)


def boosting(train: DataFrame, trees: int = 100, depth: int = 3, rate: float = 0.05, leaf: int = 10):
    _deviation(train)
    return GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, subsamplingRate=0.6, seed=42).fit(train)


FACTORIES: dict[str, Callable] = {"ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "random_forest": random_forest, "boosting": boosting}


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Absolute coefficients or tree importances, largest first."""
    values = abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def linear_contributions(model, data: DataFrame, names: list[str]) -> DataFrame:
    """(period, feature, value): coefficient times the distance from the feature's mean, exact for linear models."""
    means = data.agg(*[F.avg(c).alias(c) for c in names]).first()
    parts = [((F.col(c) - F.lit(means[c])) * float(b)).alias(c) for c, b in zip(names, model.coefficients.toArray(), strict=True)]
    return data.select("period", *parts).unpivot(["period"], names, "feature", "value")


def placebo(forecasts: DataFrame, reps: int = 200, seed: int = 7, *keys: str) -> DataFrame:
    """Share of permutations of the actuals whose |IC| is at least that observed; reps copies of the forecasts, ranked once."""
    from pyspark.sql import Window

    z = evaluation.ranked(forecasts, *keys).select(*keys, "rn", "ra", "rp")
    drawn = z.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("u", F.xxhash64(F.lit(seed), "rep", "rn"))
    mixed = drawn.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("u", "rn")))
    other = z.select(*keys, F.col("rn").alias("at"), F.col("ra").alias("drawn"))
    null = mixed.join(other, [*keys, "at"]).groupBy(*keys, "rep").agg(F.avg(F.col("drawn") * F.col("rp")).alias("ic0"))
    seen = z.groupBy(*keys).agg(F.avg(F.col("ra") * F.col("rp")).alias("ic"))
    return null.join(seen, list(keys)).groupBy(*keys, "ic").agg(F.avg((F.abs("ic0") >= F.abs("ic")).cast("double")).alias("p_value"))
