"""Imputation, scaling, quintiles and column pruning, fitted or point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w


def statistics(panel: DataFrame) -> DataFrame:
    """One row a series: what imputers and scalers are fitted to."""
    v = F.col("value")
    quarts = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = panel.groupBy("series").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), quarts.alias("q"), F.count(v).alias("n"), F.var_samp(v).alias("var"), F.count(F.lit(1)).alias("rows"))
    return stats.withColumn("q1", F.col("q")[0]).withColumn("median", F.col("q")[1]).withColumn("q3", F.col("q")[2]).drop("q")


def impute(panel: DataFrame, fitted: DataFrame, how: str = "median", fallback: float = 0.0) -> DataFrame:
    fill = F.lit(fallback) if how == "zero" else F.coalesce(how, F.lit(fallback))
    return panel.join(fitted.select("series", "mean", "median"), "series", "left").withColumn("value", F.coalesce("value", fill)).select("period", "series", "value")


def impute_expanding(panel: DataFrame, how: str = "median", fallback: float = 0.0) -> DataFrame:
    """A gap takes the statistic of the values before it; nothing is filled backwards."""
    v = F.col("value")
    before = F.percentile(v, F.lit(0.5)).over(w.past()) if how == "median" else F.avg(v).over(w.past())
    return panel.withColumn("value", F.coalesce(v, before, F.lit(fallback)))


def scale(panel: DataFrame, fitted: DataFrame, how: str = "standard") -> DataFrame:
    """By mean and population deviation, or median and interquartile range; a spread of zero counts as one."""
    centre, spread = (F.col("median"), F.col("q3") - F.col("q1")) if how == "robust" else (F.col("mean"), F.col("sd"))
    spread = F.when(spread == 0, 1.0).otherwise(spread)
    return panel.join(fitted, "series", "left").withColumn("value", (F.col("value") - centre) / spread).select("period", "series", "value")


def scale_expanding(panel: DataFrame, least: int = 36, burn_in: str = "bfill", how: str = "standard", window: int | None = None) -> DataFrame:
    """Standard scores (or by median and interquartile range, how "robust") by the statistics of strictly earlier rows, all of
    them or the last `window`; the first rows take the first such statistics (burn_in "bfill", which looks ahead)
    or stay null; null results become 0 under "bfill"."""
    v = F.col("value")
    frame = w.past() if window is None else w.by_series().rowsBetween(-window, -1)
    if how == "robust":
        quarts = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        rows = panel.withColumn("q", w.guarded(quarts, v, frame, least)).withColumn("m", F.col("q")[1]).withColumn("s", F.col("q")[2] - F.col("q")[0]).drop("q")
    else:
        rows = panel.withColumn("m", w.mean(v, frame, least)).withColumn("s", w.sd(v, frame, least))
    rows = rows.withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    if burn_in == "bfill":
        rows = rows.withColumn("m", w.backward_fill(F.col("m"))).withColumn("s", w.backward_fill(F.col("s")))
    out = (v - F.col("m")) / F.col("s")
    return rows.select("period", "series", (F.coalesce(out, F.lit(0.0)) if burn_in == "bfill" else out).alias("value"))


def quintile_features(panel: DataFrame, least: int = 60) -> DataFrame:
    """panel with quintile and Q1..Q5 (null where the quintile is)."""
    out = panel.withColumn("quintile", w.quintile(F.col("value"), least))
    for k in range(1, 6):
        out = out.withColumn(f"Q{k}", F.when(F.col("quintile").isNotNull(), (F.col("quintile") == k).cast("double")))
    return out


def fit_quintiles(train: DataFrame) -> DataFrame:
    """(series, edges): the distinct quintile edges of the training values."""
    points = F.array(*[F.lit(q) for q in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)])
    return train.filter("value is not null").groupBy("series").agg(F.array_distinct(F.percentile("value", points)).alias("edges"))


def apply_quintiles(panel: DataFrame, fitted: DataFrame) -> DataFrame:
    """Q1..Q5 as 0 or 1; right-closed bins, the lowest edge included; outside the training range and for nulls all are 0."""
    rows = panel.join(fitted, "series", "left")
    v, edges = F.col("value"), F.col("edges")
    inside = v.between(F.element_at(edges, 1), F.element_at(edges, -1))
    above = F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < v)))
    place = F.when(inside & (F.size(edges) > 1), above)
    return rows.select("period", "series", "value", *[F.coalesce((place == k).cast("int"), F.lit(0)).alias(f"Q{k}") for k in range(1, 6)])


def quintile_spread(forecasts: DataFrame, bins: int = 5, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Mean actual of each bin of the forecast's first rank, as the edges of unique ranks cut it."""
    order = Window.partitionBy(*keys).orderBy("predicted", "period")
    whole = Window.partitionBy(*keys)
    ranked = forecasts.filter("predicted is not null and actual is not null").withColumn("rk", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole))
    bin_ = F.greatest(F.lit(1), F.ceil((F.col("rk") - 1) * bins / (F.col("n") - 1)).cast("int"))
    return ranked.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.avg("actual").alias("mean_actual"), F.count(F.lit(1)).alias("n"))


def prune(stats: DataFrame, rows: int, spare: int = 20) -> DataFrame:
    """Series with values that vary, fewest gaps and largest variance first, at most rows - spare of them."""
    usable = stats.filter("n > 0 and var > 0").withColumn("gaps", F.lit(rows) - F.col("n"))
    return usable.orderBy("gaps", F.desc("var"), "series").limit(max(1, rows - spare))


def required(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Exactly the required series at every period: carried forward, else 0; an absent series is 0 throughout."""
    periods = panel.select("period").distinct()
    grid = periods.join(F.broadcast(features), F.lit(True)).join(panel, ["period", "series"], "left")
    return grid.withColumn("value", F.coalesce(w.forward_fill(F.col("value")), F.lit(0.0)))


def first_by_priority(features: DataFrame) -> DataFrame:
    """Of equal (period, series) the one with the lowest priority stays."""
    rank = F.row_number().over(Window.partitionBy("period", "series").orderBy("priority", "value"))
    return features.withColumn("x_rank", rank).filter("x_rank = 1").drop("x_rank")
