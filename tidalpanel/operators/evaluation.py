"""Forecast metrics, rank correlation with overlap-aware errors, multiple testing and ratings.

Forecasts are rows (keys..., period, actual, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w

# Excellent, good, acceptable, minimum and suspicious information coefficients.
RATINGS = {"equities": (0.12, 0.08, 0.05, 0.03, 0.20), "bonds": (0.18, 0.12, 0.08, 0.05, 0.30), "commodities": (0.10, 0.06, 0.04, 0.02, 0.18)}


def complete(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter("actual is not null and predicted is not null")


def metrics(forecasts: DataFrame, *keys: str) -> DataFrame:
    """n, rmse, mae, r2, hit_rate and the absolute error where the sign was right."""
    e, a, p = F.col("actual") - F.col("predicted"), F.col("actual"), F.col("predicted")
    right = F.signum(a) == F.signum(p)
    out = complete(forecasts).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(a).alias("var"),
        F.avg(right.cast("double")).alias("hit_rate"), F.avg(F.when(right, F.abs(e))).alias("directional_mae"),
    )
    return out.withColumn("r2", 1 - F.col("mse") / w.nonzero(F.col("var"))).drop("mse", "var")


def ranked(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Standardised average ranks ra and rp, with rn in time order and n; deviations are those of the population."""
    rows = complete(forecasts).withColumn("ra", w.average_rank(F.col("actual"), *keys)).withColumn("rp", w.average_rank(F.col("predicted"), *keys))
    whole = Window.partitionBy(*keys)
    for c in ("ra", "rp"):
        rows = rows.withColumn(c, (F.col(c) - F.avg(c).over(whole)) / w.nonzero(F.stddev_pop(c).over(whole)))
    return rows.withColumn("rn", F.row_number().over(whole.orderBy("period"))).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("z", F.col("ra") * F.col("rp"))


def information_coefficient(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Spearman correlation; null for fewer than three rows, 0 for a constant side."""
    rows = ranked(forecasts, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("ic"))
    return rows.withColumn("ic", F.when(F.col("n") >= 3, F.coalesce("ic", F.lit(0.0))))


def kernel(name: str, j: Column, top: Column) -> Column:
    x = j / (top + 1)
    if name == "bartlett":
        return 1 - x
    if name == "parzen":
        return F.when(x <= 0.5, 1 - 6 * x * x + 6 * x * x * x).otherwise(2 * F.pow(1 - x, F.lit(3)))
    if name == "quadratic":
        z = 6 * F.lit(3.141592653589793) * x / 5
        return F.when(j == 0, 1.0).otherwise(3 / (z * z) * (F.sin(z) / z - F.cos(z)))
    return F.lit(1.0)


def autocovariances(rows: DataFrame, value: str, lags: int, *keys: str, centred: bool = True, by_n: bool = False) -> DataFrame:
    """(keys, j, g): covariance of value with itself j rows before; mean over the pairs, or their sum over n.

    One window pass gives the lags; no self-join."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("rn")
    rows = rows.withColumn("x_v", F.col(value) - (F.avg(value).over(whole) if centred else F.lit(0.0)))
    wide = rows.select(*keys, *[(F.col("x_v") * F.lag("x_v", j).over(order)).alias(f"g{j}") for j in range(lags + 1)])
    sums = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.sum(f"g{j}") / F.count(F.lit(1)) if by_n else F.avg(f"g{j}")).alias(f"g{j}") for j in range(lags + 1)])
    return sums.select(*keys, "n", F.posexplode(F.array(*[f"g{j}" for j in range(lags + 1)])).alias("j", "g"))


def rank_errors(forecasts: DataFrame, h: int, *keys: str, weights: str = "bartlett") -> DataFrame:
    """(keys, n, se): long-run standard error of the IC with h - 1 lags; weights "equal" is Hansen-Hodrick."""
    g = autocovariances(ranked(forecasts, *keys), "z", h - 1, *keys)
    part = F.when(F.col("j") == 0, F.col("g")).otherwise(2 * kernel(weights, F.col("j"), F.lit(h - 1)) * F.col("g"))
    out = g.groupBy(*keys, "n").agg(F.sum(part).alias("lrv"))
    return out.select(*keys, "n", F.when(F.col("n") > h, F.sqrt(F.greatest(F.lit(0.0), F.col("lrv")) / F.col("n"))).alias("se"))


def effective_sizes(forecasts: DataFrame, h: int, *keys: str, most: int = 36) -> DataFrame:
    """(keys, n, simple, newey_west, hansen_hodrick, autocorr) of the forecast errors."""
    rows = complete(forecasts).withColumn("e", F.col("actual") - F.col("predicted")).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("period")))
    g = autocovariances(rows, "e", most, *keys, by_n=True)
    lists = g.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("j", "g"))).alias("x"))
    r = F.transform("x", lambda x: F.coalesce(x["g"], F.lit(0.0)) / w.nonzero(F.col("x")[0]["g"]))
    out = lists.withColumn("r", r).withColumn("n", F.col("n").cast("double")).withColumn("simple", F.greatest(F.lit(1.0), F.col("n") / h))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("r")[1]))
    a = 4 * rho * rho / (F.pow(1 - rho, F.lit(2)) * F.pow(1 + rho, F.lit(2)))
    width = F.when(F.abs(rho) < 0.01, 1).otherwise(F.greatest(F.lit(1), F.ceil(1.1447 * F.pow(a * F.col("n"), F.lit(1 / 3))).cast("int")))
    out = out.withColumn("bw", F.least(width, F.lit(most)))
    nw = F.aggregate(F.sequence(F.lit(1), F.col("bw")), F.lit(0.0), lambda s, k: s + (1 - k / (F.col("bw") + 1)) * F.element_at("r", k + 1))
    hh = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, min(h - 1, most)))), F.lit(0.0), lambda s, k: s + (1 - k / F.lit(float(h))) * F.element_at("r", k + 1))
    limit = 2 / F.sqrt("n")
    big = F.transform(F.sequence(F.lit(2), F.lit(most + 1)), lambda k: F.abs(F.element_at("r", k)) > limit)
    # the first lag that is insignificant and whose successor is too ends the run; the last significant lag before it counts
    ends = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: ~F.element_at(big, k) & ((k == most) | ~F.element_at(big, F.least(k + 1, F.lit(most)))))
    stop = F.coalesce(F.element_at(F.when(F.size(ends) > 0, ends), 1), F.lit(most + 1))
    length = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.element_at(big, k) & (k < stop))) + 1, F.lit(1))
    return out.select(
        *keys, "n", "simple", F.when(F.col("n") < 10, F.col("simple")).otherwise(F.col("n") / F.greatest(F.lit(1.0), 1 + 2 * nw)).alias("newey_west"),
        F.when(F.col("n") < h, F.col("simple")).otherwise(F.col("n") / F.greatest(F.lit(1.0), 1 + 2 * hh)).alias("hansen_hodrick"), (F.col("n") / length).alias("autocorr"),
    )


def corrections(tests: DataFrame, fwer: float = 0.05, fdr: float = 0.10, *keys: str) -> DataFrame:
    """tests (test_id, p_value) with bonferroni, holm, bh, q_value and sig_adjusted (q below the rate)."""
    group = keys or ("family",)
    rows = tests if keys else tests.withColumn("family", F.lit(1))
    order = Window.partitionBy(*group).orderBy("p_value", "test_id")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.filter("p_value is not null").withColumn("k", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    rows = rows.withColumn("bonferroni", F.col("p_value") < fwer / F.col("m"))
    rows = rows.withColumn("holm", F.max((F.col("p_value") >= fwer / (F.col("m") - F.col("k") + 1)).cast("int")).over(upto) == 0)
    rows = rows.withColumn("bh", F.max((F.col("p_value") <= F.col("k") / F.col("m") * fdr).cast("int")).over(after) == 1)
    rows = rows.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("k")).over(after))).withColumn("sig_adjusted", F.col("q_value") < fdr)
    return rows.drop("k", "m", *([] if keys else ["family"]))


def rating(ic: Column, asset_class: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (excellent, good, fair, least, _) in RATINGS.items():
        ladder = F.when(ic >= excellent, "excellent").when(ic >= good, "good").when(ic >= fair, "acceptable").when(ic >= least, "marginal").otherwise("poor")
        out = F.when(asset_class == name, ladder).otherwise(out)
    return out


def suspicious(ic: Column, asset_class: Column) -> Column:
    out = F.lit(False)
    for name, limits in RATINGS.items():
        out = F.when(asset_class == name, ic > limits[4]).otherwise(out)
    return out


def implied_sharpe(ic: Column, bets: float = 24.0, cost: float = 0.004) -> Column:
    return F.greatest(F.lit(0.0), ic * (bets**0.5) - cost * 12**0.5)


def economic(forecasts: DataFrame, bps: float = 10.0, *keys: str, target: float = 0.10) -> DataFrame:
    """Positions are the sign of the forecast against its median, held one period later and scaled to the target
    volatility; annual mean return, unscaled volatility, turnover, cost, net return and Sharpe ratio."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("period")
    rows = complete(forecasts).withColumn("pos", F.signum(F.col("predicted") - F.percentile("predicted", F.lit(0.5)).over(whole)))
    rows = rows.withColumn("ret", F.lag("pos").over(order) * F.col("actual")).withColumn("turn", F.abs(F.col("pos") - F.lag("pos").over(order)))
    out = rows.groupBy(*keys).agg((F.avg("ret") * 12).alias("mean_return"), (F.stddev_samp("ret") * 12**0.5).alias("volatility"), F.avg("turn").alias("turnover"))
    scale = F.when(F.col("volatility") > 0, target / F.col("volatility")).otherwise(1.0)
    out = out.withColumn("mean_return", F.col("mean_return") * scale).withColumn("cost", F.col("turnover") * bps / 1e4 * 12)
    return out.withColumn("net_return", F.col("mean_return") - F.col("cost")).withColumn("sharpe", F.col("net_return") / target if target > 0 else F.lit(0.0))


def spearman_matrix(panel: DataFrame) -> DataFrame:
    """(a, b, rho, distance) of all pairs of series, over the periods that both have.

    Pairs are of series, a bounded set of features, and join on the period."""
    x = panel.filter("value is not null").select("period", F.col("series").alias("a"), F.col("value").alias("va"))
    y = panel.filter("value is not null").select("period", F.col("series").alias("b"), F.col("value").alias("vb"))
    both = x.join(y, "period").filter("a <= b").withColumn("ra", w.average_rank(F.col("va"), "a", "b")).withColumn("rb", w.average_rank(F.col("vb"), "a", "b"))
    rho = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))
    rho = rho.withColumn("rho", F.when((F.col("n") > 1) & ~F.isnan("rho"), F.col("rho")))
    return rho.withColumn("distance", F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce("rho", F.lit(0.0)))))


def ensemble(forecasts: DataFrame, models: int, *keys: str) -> DataFrame:
    """Mean forecast of the periods that all models have."""
    out = complete(forecasts).groupBy(*keys, "period").agg(F.avg("predicted").alias("predicted"), F.max("actual").alias("actual"), F.count_distinct("model").alias("m"))
    return out.filter(F.col("m") == models).drop("m")


def consensus(forecasts: DataFrame, *keys: str) -> DataFrame:
    """Share of models above zero in each period, and the vote."""
    out = forecasts.filter("predicted is not null").groupBy(*keys, "period").agg(F.avg((F.col("predicted") > 0).cast("double")).alias("bullish"))
    return out.withColumn("vote", F.when(F.col("bullish") > 0.6, "BULLISH").when(F.col("bullish") < 0.4, "BEARISH").otherwise("NEUTRAL"))


def percentile_signal(panel: DataFrame) -> DataFrame:
    """Per series the share of values strictly below the latest, in percent, and its label."""
    rows = panel.filter("value is not null")
    last = rows.groupBy("series").agg(F.max_by("value", "period").alias("current"))
    out = rows.join(last, "series").groupBy("series", "current").agg((F.avg((F.col("value") < F.col("current")).cast("double")) * 100).alias("percentile"))
    p = F.col("percentile")
    return out.withColumn("signal", F.when(p > 80, "Very High").when(p > 60, "High").when(p > 40, "Neutral").when(p > 20, "Low").otherwise("Very Low"))


def top_k(results: DataFrame, metric: str, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(metric), "model"))
    return results.filter(F.col(metric).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= k)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of keys that are not in this run, and the run's rows."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
