"""Information coefficients with overlap-aware inference, revisions, stability labels and selection audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import evaluation, stats

# What a deployable model needs.
LEAST_IC, MOST_RISK, LEAST_STABILITY = 0.15, 0.30, 0.70
#: Share of all importance from which a single feature is an alert.
DOMINANT = 0.30


def lag_sums(rows: DataFrame, value: str, lags: int, *keys: str) -> DataFrame:
    """(keys, n, s, c): for each lag 0..lags the sum of products of centred values and how many there are. One window pass."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("rn")
    rows = rows.withColumn("x_v", F.col(value) - F.avg(value).over(whole))
    wide = rows.select(*keys, *[(F.col("x_v") * F.lag("x_v", j).over(order)).alias(f"g{j}") for j in range(lags + 1)])
    sums, counts = F.array(*[F.sum(f"g{j}") for j in range(lags + 1)]), F.array(*[F.count(f"g{j}") for j in range(lags + 1)])
    return wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sums.alias("s"), counts.alias("c"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def long_run_error(h: int, weights: str) -> Column:
    """Standard error of a mean from lag_sums() with h - 1 lags; null with no more rows than h."""
    g = F.zip_with(F.slice("s", 1, h), F.slice("c", 1, h), lambda s, c: F.coalesce(s / w.nonzero(c), F.lit(0.0)))
    parts = F.transform(g, lambda x, j: F.when(j == 0, x).otherwise(2 * evaluation.kernel(weights, j, F.lit(h - 1)) * x))
    return F.when(F.col("n") > h, F.sqrt(F.greatest(F.lit(0.0), _total(parts)) / F.col("n")))


def rank_error_table(forecasts: DataFrame, h: int, weights: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, n, one error for each kernel): the products of lagged rows are made once for all kernels."""
    sums = lag_sums(evaluation.ranked(forecasts, *keys), "z", h - 1, *keys)
    return sums.select(*keys, "n", *[long_run_error(h, name).alias(name) for name in weights])


def newey_west_size(most: int = 36) -> Column:
    """Effective sample size from lag_sums(): automatic bandwidth from the first autocorrelation."""
    n = F.col("n").cast("double")
    r = F.transform("s", lambda x: F.coalesce(x / w.nonzero(F.col("s")[0]), F.lit(0.0)))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce(F.col("s")[1] / w.nonzero(F.col("s")[0]), F.lit(0.0))))
    a = 4 * rho * rho / (F.pow(1 - rho, F.lit(2)) * F.pow(1 + rho, F.lit(2)))
    width = F.when(F.abs(rho) < 0.01, 1).otherwise(F.greatest(F.lit(1), F.ceil(1.1447 * F.pow(a * n, F.lit(1 / 3))).cast("int")))
    width = F.least(width, F.lit(most))
    parts = F.transform(r, lambda x, j: F.when((j > 0) & (j <= width), (1 - j / (width + 1)) * x).otherwise(0.0))
    return n / F.greatest(F.lit(1.0), 1 + 2 * _total(parts))


def ic_inference(forecasts: DataFrame, h: int, *keys: str, alpha: float = 0.05, most: int = 36) -> DataFrame:
    """(keys, n, ic, se_raw, se_nw, se_hh, effective_n, t_stat, p_value, ci_low, ci_high) of the rank correlation.

    Errors need more rows than h; a constant side has IC 0 and nothing else; degrees of freedom are effective_n - 2, at least 1."""
    rows = evaluation.ranked(forecasts, *keys)
    ic = rows.groupBy(*keys).agg(F.avg("z").alias("ic"), F.count(F.lit(1)).alias("n"))
    sums = lag_sums(rows, "z", max(h - 1, most), *keys)
    simple = F.greatest(F.lit(1.0), F.col("n").cast("double") / h)
    size = F.when(F.col("n") < 10, simple).otherwise(newey_west_size(most))
    errors = sums.select(*keys, long_run_error(h, "bartlett").alias("se_nw"), long_run_error(h, "equal").alias("se_hh"), size.alias("size"))
    out = ic.join(errors, list(keys)) if keys else ic.crossJoin(errors)
    varies = F.col("ic").isNotNull()
    out = out.withColumn("effective_n", F.when(varies, F.col("size")).otherwise(F.greatest(F.lit(1.0), F.floor(F.col("n") / h).cast("double"))))
    out = out.withColumn("se_raw", F.when(varies & (F.col("n") > 2), F.sqrt((1 - F.col("ic") * F.col("ic")) / (F.col("n") - 2))))
    for c in ("se_nw", "se_hh"):
        out = out.withColumn(c, F.when(varies, F.col(c)))
    df = F.greatest(F.lit(1.0), F.col("effective_n") - 2)
    out = out.withColumn("t_stat", F.when(F.col("se_nw") > 0, F.col("ic") / F.col("se_nw"))).withColumn("p_value", stats.t_p_value("t_stat", df))
    reach = stats.t_critical(F.lit(1 - alpha / 2), df) * F.when(F.col("se_nw") > 0, F.col("se_nw"))
    out = out.withColumn("reach", reach).withColumn("ci_low", F.col("ic") - F.col("reach")).withColumn("ci_high", F.col("ic") + F.col("reach"))
    return out.withColumn("ic", F.coalesce("ic", F.lit(0.0))).drop("size", "reach")


def legacy_size(n: Column, h: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n / h).cast("long"))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def revision_risk(revised: Column, realtime: Column) -> Column:
    """Share of the IC on revised data that is lost in real time; null unless that is positive."""
    return F.when(revised > 0, (revised - realtime) / revised)


def vintage_revision_risk(revised: Column, realtime: Column) -> Column:
    """As the vintage loop counts it: 0 where the revised IC is next to nothing."""
    return F.when(F.abs(revised) > 1e-6, (revised - realtime) / revised).otherwise(0.0)


def feature_stability(revised: DataFrame, realtime: DataFrame, *keys: str) -> DataFrame:
    """(keys, features, stability): rank correlation of importances (keys, feature, value) on the features that both have; null below three."""
    both = revised.select(*keys, "feature", F.col("value").alias("actual")).join(realtime.select(*keys, "feature", F.col("value").alias("predicted")), [*keys, "feature"])
    out = evaluation.information_coefficient(both.withColumnRenamed("feature", "period"), *keys)
    return out.select(*keys, F.col("n").alias("features"), F.col("ic").alias("stability"))


def deployable(models: DataFrame) -> DataFrame:
    """models (ic, risk, stability) with a column for each criterion and all of them; what is missing fails."""
    checks = {"ic_ok": F.col("ic") > LEAST_IC, "risk_ok": F.col("risk") < MOST_RISK, "stability_ok": F.col("stability") > LEAST_STABILITY}
    for name, check in checks.items():
        models = models.withColumn(name, F.coalesce(check, F.lit(False)))
    return models.withColumn("deployable", F.col("ic_ok") & F.col("risk_ok") & F.col("stability_ok"))


def stability_label(share: Column) -> Column:
    return F.when(share > 0.8, "Stable").when(share > 0.5, "Marginal").otherwise("Unstable")


def selection_stability(selected: DataFrame, folds: int) -> DataFrame:
    """selected (fold_id, feature) -> (feature, times, share, label, always): how steadily folds choose a feature."""
    out = selected.groupBy("feature").agg(F.count_distinct("fold_id").alias("times")).withColumn("share", F.col("times") / F.lit(folds))
    return out.withColumn("label", stability_label(F.col("share"))).withColumn("always", F.col("times") == folds)


def selection_changes(selected: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the candidates that some fold selects, those that none does): a semi join and a difference."""
    chosen = selected.select("feature").distinct()
    return candidates.join(chosen, "feature", "left_semi"), candidates.select("feature").exceptAll(chosen.intersect(candidates.select("feature")))


def mean_importance(importances: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, value, share, rank): over folds, with its share of the whole."""
    mean = importances.groupBy(*keys, "feature").agg(F.avg("value").alias("value"))
    whole = Window.partitionBy(*keys)
    out = mean.withColumn("share", F.col("value") / w.nonzero(F.sum("value").over(whole)))
    return out.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("value"), "feature")))


def dominance(importances: DataFrame, *keys: str) -> DataFrame:
    """Features that alone drive more than DOMINANT of a model."""
    return importances.groupBy(*keys).agg(F.max(F.struct("value", "feature")).alias("x")).select(*keys, "x.feature", "x.value").filter(F.col("value") > DOMINANT)


def benchmark(results: DataFrame) -> DataFrame:
    """results (asset_class, ic) with rating, suspicious, implied and naive Sharpe ratios and a list of warnings."""
    ic, kind = F.col("ic"), F.col("asset_class")
    rating, odd = evaluation.rating(ic, kind), evaluation.suspicious(ic, kind)
    found = F.array(
        F.when(odd, "suspiciously high"), F.when(rating == "poor", "below the minimum"), F.when(ic < 0, "negative"), F.when(ic.isNull(), "missing"),
    )
    out = results.withColumn("rating", rating).withColumn("suspicious", odd).withColumn("sharpe", evaluation.implied_sharpe(ic)).withColumn("naive_sharpe", ic * 12**0.5)
    return out.withColumn("warnings", F.array_join(F.filter(found, lambda x: x.isNotNull()), "; "))


def correction_detail(tests: DataFrame, fwer: float = 0.05, fdr: float = 0.10) -> DataFrame:
    """(method, level, tests, rejected, least_p, most_p_rejected) of every correction, as one table."""
    rows = evaluation.corrections(tests, fwer, fdr)
    methods = {"none": (F.col("p_value") < fwer, fwer), "bonferroni": (F.col("bonferroni"), fwer), "holm": (F.col("holm"), fwer), "benjamini_hochberg": (F.col("bh"), fdr)}
    each = F.array(*[F.struct(F.lit(name).alias("method"), F.lit(level).alias("level"), hit.alias("hit")) for name, (hit, level) in methods.items()])
    long = rows.select("p_value", F.explode(each).alias("x")).select("p_value", "x.*")
    return long.groupBy("method", "level").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("hit").alias("rejected"), F.min("p_value").alias("least_p"), F.max(F.when(F.col("hit"), F.col("p_value"))).alias("most_p_rejected")
    )


def weighted_ensemble(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """(period, predicted, actual): forecasts of models weighted by (model, weight), over the models that a period has."""
    rows = evaluation.complete(forecasts).join(weights, "model")
    out = rows.groupBy("period").agg(F.sum(F.col("weight") * F.col("predicted")).alias("s"), F.sum("weight").alias("t"), F.max("actual").alias("actual"))
    return out.select("period", (F.col("s") / w.nonzero(F.col("t"))).alias("predicted"), "actual")


def monotonicity(bins: DataFrame, top: int = 5, *keys: str) -> DataFrame:
    """quintile_spread() bins -> (keys, spread, monotonicity): top mean less bottom mean, and the rank correlation of bin and mean."""
    ends = bins.groupBy(*keys).agg((F.max(F.when(F.col("bin") == top, F.col("mean_actual"))) - F.max(F.when(F.col("bin") == 1, F.col("mean_actual")))).alias("spread"))
    rank = evaluation.information_coefficient(bins.select(*keys, F.col("bin").alias("period"), F.col("mean_actual").alias("actual"), F.col("bin").cast("double").alias("predicted")), *keys)
    return ends.join(rank.select(*keys, F.col("ic").alias("monotonicity")), list(keys))


def regime_ics(forecasts: DataFrame, spans: DataFrame, least: int = 5) -> DataFrame:
    """IC by regime; null below `least` rows."""
    from tidalpanel.operators import align

    rows = align.label(evaluation.complete(forecasts), spans)
    out = evaluation.information_coefficient(rows.select("regime", "period", "actual", "predicted"), "regime")
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def safe_target(target: DataFrame, months: int = 24, before: str | None = None, least: int = 60) -> DataFrame:
    """The target (period, value) that selection may see: shifted by `months` rows, or only what was realised `months` before
    a validation start. Too few rows are an error."""
    if before is None:
        rows = target.withColumn("value", F.lag("value", months).over(Window.orderBy("period"))).filter("value is not null")
    else:
        rows = target.filter((F.col("period") < F.add_months(F.lit(before).cast("date"), -months)) & F.col("value").isNotNull())
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} safe observations; at least {least} are needed")
    return rows


def sequence_length(strategy: str, horizon: int, override: int | None = None) -> int:
    """Rows of a sequence: short 6, medium 12, adaptive half the horizon up to 12, full the horizon."""
    if override is not None:
        return override
    return {"short": 6, "medium": 12, "adaptive": min(12, horizon // 2), "full": horizon}[strategy]


def theoretical_sequences(n: Column | int, length: int, stride: int = 1):
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.lit(0), F.floor((n - length) / stride).cast("long") + 1)


def sequences(panel: DataFrame, length: int, stride: int = 1, *keys: str) -> DataFrame:
    """(keys, period, values): the windows of `length` rows without a null that end at every stride-th place."""
    keys = keys or ("series",)
    frame = w.rolling(length, *keys)
    rows = panel.withColumn("x_at", F.row_number().over(w.by_series(*keys))).withColumn("values", F.collect_list("value").over(frame))
    rows = rows.filter((F.size("values") == length) & (F.col("x_at") >= length) & ((F.col("x_at") - length) % stride == 0))
    return rows.select(*keys, "period", "values")


def validate_sequences(panel: DataFrame, length: int, stride: int = 1, least: int = 100, *keys: str) -> DataFrame:
    """(keys, rows, possible, usable, valid, reason): whether enough windows without nulls are left."""
    keys = keys or ("series",)
    usable = sequences(panel, length, stride, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("usable"))
    out = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).join(usable, list(keys), "left").withColumn("usable", F.coalesce("usable", F.lit(0)))
    out = out.withColumn("possible", theoretical_sequences(F.col("rows"), length, stride)).withColumn("valid", F.col("usable") >= least)
    return out.withColumn("reason", F.when(~F.col("valid"), F.concat(F.lit("Total sequences "), F.col("usable").cast("string"), F.lit(f" below {least}"))))
