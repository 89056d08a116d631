"""Resampling, nested evaluation, stability, vintages, feature pipelines and reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import align, evaluation, preprocess, stats, transforms


def block_draws(forecasts: DataFrame, h: int, reps: int, seed: int, *keys: str) -> DataFrame:
    """(keys, rep, period, actual, predicted): n // h blocks of h rows drawn with replacement, reps times.

    Picks depend on the repeat and the place only, so keys of equal length are drawn together."""
    rows = evaluation.complete(forecasts).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("period")) - 1)
    rows = rows.withColumn("block", F.floor(F.col("rn") / h)).withColumn("place", F.col("rn") % h)
    size = rows.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / h).cast("int").alias("blocks")).filter("blocks > 0")
    draws = size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("slot", F.explode(F.expr("sequence(0, blocks - 1)")))
    draws = draws.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "rep", "slot"), F.col("blocks").cast("long")))
    drawn = draws.join(rows, [*keys, "block"])
    return drawn.select(*keys, "rep", (F.col("slot") * h + F.col("place")).alias("period"), "actual", "predicted")


def block_bootstrap(forecasts: DataFrame, h: int, reps: int = 1000, seed: int = 42, *keys: str) -> DataFrame:
    """(keys, se, low, high) of the IC: deviation and the central 95 percent over the repeats."""
    ics = evaluation.information_coefficient(block_draws(forecasts, h, reps, seed, *keys), *keys, "rep")
    return ics.groupBy(*keys).agg(F.stddev_pop("ic").alias("se"), F.percentile("ic", F.lit(0.025)).alias("low"), F.percentile("ic", F.lit(0.975)).alias("high"))


def romano_wolf(forecasts: DataFrame, h: int, reps: int = 500, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(model, ic, t, critical, significant): single step, by the largest |t* - t| over models in each repeat."""
    seen = evaluation.information_coefficient(forecasts, "model").withColumn("scale", F.sqrt((1 - F.col("ic") * F.col("ic")) / (F.col("n") - 2)))
    seen = seen.select("model", "ic", "scale", (F.col("ic") / w.nonzero(F.col("scale"))).alias("t"))
    drawn = evaluation.information_coefficient(block_draws(forecasts, h, reps, seed, "model"), "model", "rep").select("model", "rep", F.col("ic").alias("drawn"))
    far = drawn.join(F.broadcast(seen), "model").groupBy("rep").agg(F.max(F.abs(F.col("drawn") - F.col("ic")) / w.nonzero(F.col("scale"))).alias("m"))
    critical = far.agg(F.percentile("m", F.lit(1 - alpha)).alias("critical"))
    out = seen.join(F.broadcast(critical), F.lit(True))
    return out.select("model", "ic", "t", "critical", (F.abs("t") > F.col("critical")).alias("significant"))


def rolling_stability(panel: DataFrame, pairs: DataFrame, window: int = 120, step: int = 12, alpha: float = 0.10) -> DataFrame:
    """(name, windows, stability, factor): share of windows in which the pair's residual test rejects, and the factor of a
    pair's weight. With fewer than window + 24 rows nothing is tested: the share is null and the factor a half."""
    x = panel.filter("value is not null").select("period", F.col("series").alias("a"), F.col("value").alias("va"))
    y = panel.filter("value is not null").select("period", F.col("series").alias("b"), F.col("value").alias("vb"))
    both = x.join(F.broadcast(pairs), "a").join(y, ["period", "b"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period")
        a, b = rows["va"].to_numpy(float), rows["vb"].to_numpy(float)
        hits = []
        for at in range(0, len(a) - window, step) if len(a) >= window + stats.SPARE_ROWS else ():
            u, v = a[at : at + window], b[at : at + window]
            e = stats.ols(u, np.column_stack([v, np.ones(window)]))[2]
            hits.append(stats.from_critical(stats.adf(e, False)[0], stats.ENGLE_GRANGER_CRITICAL) < alpha)
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "windows": [len(hits)], "stability": [float(np.mean(hits)) if hits else None]})

    out = both.groupBy("name").applyInPandas(run, "name string, windows int, stability double")
    return out.withColumn("factor", F.when(F.col("windows") == 0, 0.5).otherwise(stats.steadiness(F.col("stability"))))


def representatives(panel: DataFrame, clusters: DataFrame, how: str = "centroid", target: DataFrame | None = None, least: int = 0, seed: int = 42) -> DataFrame:
    """(cluster, series) chosen for each cluster: first by name, at random (by a seeded hash), largest variance, largest
    |Spearman| with the cluster's mean (centroid) or with a target (ic); auto takes the target's (without one the variance) for
    clusters of up to three and the centroid for larger ones. A single member is chosen as it is; with `least`, only periods that all
    members have count, and a cluster with fewer of them gives its first member. clusters has (feature, cluster)."""
    members = clusters.select(F.col("feature").alias("series"), "cluster")
    if how == "auto":
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        small, large = (clusters.join(sizes.filter(c).select("cluster"), "cluster", "left_semi") for c in ("n <= 3", "n > 3"))
        few = representatives(panel, small, "ic" if target is not None else "variance", target, least, seed)
        return few.unionByName(representatives(panel, large, "centroid", None, least, seed))
    rows = panel.join(members, "series")
    if least:
        order = Window.partitionBy("cluster", "period")
        rows = rows.withColumn("x_whole", F.count("value").over(order) == F.count(F.lit(1)).over(order)).filter("x_whole").drop("x_whole")
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.min("series").alias("x_first"))
        enough = rows.groupBy("cluster").agg(F.count_distinct("period").alias("n")).join(sizes, "cluster", "right")
        plain = enough.filter(f"m = 1 or coalesce(n, 0) < {least}").select("cluster", F.col("x_first").alias("series"))
        rest = clusters.join(plain.select("cluster"), "cluster", "left_anti")
        chosen = representatives(rows.select("period", "series", "value"), rest, how, target, 0, seed)
        return plain.unionByName(chosen.select("cluster", "series"))
    rows = rows.filter("value is not null")
    if how == "random":
        return rows.groupBy("cluster").agg(F.min_by("series", F.xxhash64(F.lit(seed), "series")).alias("series"))
    if how == "first":
        return rows.groupBy("cluster").agg(F.min("series").alias("series"))
    if how == "variance":
        score = rows.groupBy("cluster", "series").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("score"))
    else:
        if how == "centroid":
            goal = rows.groupBy("cluster", "period").agg(F.avg("value").alias("actual"))
            both = rows.join(goal, ["cluster", "period"])
        else:
            both = rows.join(target.select("period", F.col("value").alias("actual")), "period")
        ic = evaluation.information_coefficient(both.withColumnRenamed("value", "predicted"), "cluster", "series")
        score = ic.select("cluster", "series", F.coalesce(F.abs("ic"), F.lit(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 12)), "series"))
    return score.withColumn("rank", rank).filter("rank = 1").select("cluster", "series")


def same_base(clusters: DataFrame) -> DataFrame:
    """(cluster, base, n) of base names that a cluster holds as both level and slope."""
    base = F.regexp_replace("feature", r"_(level|chg|accel|zscore|quintile|Q\d).*$", "")
    return clusters.groupBy("cluster", base.alias("base")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def base_features(panel: DataFrame, codes: DataFrame, definitions: DataFrame, windows: tuple[int, ...] = transforms.MOMENTUM) -> DataFrame:
    """(period, feature, value): transformed series, ratios and spreads with their changes, momentum and raw levels; of equal names the first block stays."""
    moved = transforms.transform(panel, codes).select("period", F.col("series").alias("feature"), F.col("out").alias("value"))
    ratios = transforms.pairs(panel, definitions)
    blocks = [moved, ratios.withColumnRenamed("series", "feature"), transforms.changes(ratios), transforms.momentum(panel, windows)]
    blocks.append(panel.select("period", F.concat("series", F.lit("_level")).alias("feature"), "value"))
    out = None
    for k, block in enumerate(blocks):
        part = block.select("period", F.col("feature").alias("series"), "value").withColumn("priority", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return preprocess.first_by_priority(out).select("period", F.col("series").alias("feature"), "value")


def frozen_features(panel: DataFrame, codes: DataFrame, definitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The features that a trained model asks for (wanted: series), from a panel as it was known: carried forward, absent ones 0."""
    every = base_features(panel, codes, definitions).withColumnRenamed("feature", "series")
    return preprocess.required(every, wanted)


def known_at(vintages: DataFrame) -> DataFrame:
    """vintages (vintage, period, series, value): each vintage's last values and their scores by its own history only."""
    keys = ("vintage", "series")
    v = F.col("value")
    rows = vintages.withColumn("zscore", w.zscore(v, w.expanding(*keys))).withColumn("filled", w.forward_fill(v, *keys))
    last = rows.groupBy(*keys).agg(F.max(F.struct("period", "filled", "zscore")).alias("x"))
    return last.select(*keys, "x.*")


def truncated(panel: DataFrame, every: int = 6) -> DataFrame:
    """Vintages of a panel that was never revised: what each `every`-th month had seen."""
    months = panel.select(F.col("period").alias("vintage")).distinct().filter(F.month("vintage") % every == 0)
    return panel.join(F.broadcast(months), F.col("period") <= F.col("vintage"))


def regime_vote(signals: DataFrame) -> DataFrame:
    """Counts of high and low signals and a probability of 50 + 5 for each one more, between 1 and 99."""
    high = F.count(F.when(F.col("signal").contains("High"), 1))
    low = F.count(F.when(F.col("signal").contains("Low"), 1))
    out = signals.agg(high.alias("high"), low.alias("low"))
    return out.withColumn("probability", F.least(F.lit(99), F.greatest(F.lit(1), 50 + 5 * (F.col("high") - F.col("low")))))


def alignment(features: DataFrame, targets: DataFrame, months: int) -> DataFrame:
    """Rows and span of the aligned sample, and whether any feature is younger than its target allows."""
    joined = align.lagged(features.withColumn("known", F.col("period")).select("period", "series", F.col("known").alias("value")), targets, months)
    late = F.add_months(F.col("value"), months) > F.col("period")
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.when(late, 1)).alias("look_ahead"))


def report(title: str, table: DataFrame, most: int = 100) -> str:
    """Fixed-width text of a small result; more rows than `most` are an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a text report")
    text = [[f"{x:.4f}" if isinstance(x, float) else "-" if x is None else str(x) for x in r] for r in rows]
    width = [max(len(c), *(len(t[i]) for t in text)) if text else len(c) for i, c in enumerate(table.columns)]
    line = lambda cells: "  ".join(c.ljust(n) for c, n in zip(cells, width, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(table.columns), line(["-" * n for n in width]), *map(line, text)])
