"""Further registered queries: inference, revisions, selection audits, definitions, sequences and reports, with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import align, evaluation, inference, learners, preprocess, transforms, validation
from tidalpanel.plans import panels
from tidalpanel.plans.catalogue import FC, LD, MODELS, PD, PW, RANKS, W_SQL, forecasts, lm, models, pm, pw, shown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return put


# ---- inference

# Student's t by Simpson's rule on its density, 2000 steps from 0 to |t|
_T_SQL = """t AS (SELECT *, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS k FROM e), p AS (
  SELECT series, 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * k * (1 + (abs(t_stat) * i / 2000) ** 2 / df) ** (-(df + 1) / 2)) * any_value(abs(t_stat)) / 2000 / 3 AS p
  FROM t, (SELECT unnest(range(0, 2001)) AS i) GROUP BY series)"""


@query(
    "ic_inference",
    f"""WITH {RANKS}, j AS (SELECT unnest(range(0, 37)) AS j), g AS (SELECT x.series, x.n, j, sum(x.c * y.c) AS s, count(*) AS m FROM j, c x JOIN c y ON y.series = x.series AND y.rn = x.rn - j GROUP BY 1, 2, 3),
r AS (SELECT g.*, g.s / z.s AS r FROM g JOIN (SELECT series, s FROM g WHERE j = 0) z USING (series)), q AS (SELECT series, n, greatest(-0.99, least(0.99, r)) AS rho FROM r WHERE j = 1),
b AS (SELECT series, least(36, CASE WHEN abs(rho) < 0.01 THEN 1 ELSE greatest(1, ceil(1.1447 * (4 * rho ** 2 / ((1 - rho) ** 2 * (1 + rho) ** 2) * n) ** (1 / 3.0))) END) AS bw FROM q),
a AS (SELECT r.series, r.n, sqrt(greatest(0, sum(s / m * CASE WHEN j = 0 THEN 1 WHEN j < 12 THEN 2 * (1 - j / 12.0) ELSE 0 END)) / r.n) AS se_nw, sqrt(greatest(0, sum(s / m * CASE WHEN j = 0 THEN 1 WHEN j < 12 THEN 2 ELSE 0 END)) / r.n) AS se_hh,
  r.n / greatest(1, 1 + 2 * sum(CASE WHEN j BETWEEN 1 AND bw THEN (1 - j / (bw + 1)) * r ELSE 0 END)) AS size FROM r JOIN b USING (series) GROUP BY r.series, r.n),
i AS (SELECT series, avg(z) AS ic FROM z GROUP BY series), e AS (SELECT a.*, ic, sqrt((1 - ic * ic) / (n - 2)) AS se_raw, ic / se_nw AS t_stat, greatest(1, size - 2) AS df FROM a JOIN i USING (series)), {_T_SQL}
SELECT series, n, round(ic, 6) AS ic, round(se_raw, 6) AS se_raw, round(se_nw, 6) AS se_nw, round(se_hh, 6) AS se_hh, round(size, 4) AS effective_n, round(t_stat, 4) AS t_stat, round(p, 5) AS p_value FROM e JOIN p USING (series)""",
)
def _(spark, d):
    out = inference.ic_inference(forecasts(spark, d), 12, "series").drop("ci_low", "ci_high")
    return shown(out.withColumn("effective_n", F.round("effective_n", 4)).withColumn("t_stat", F.round("t_stat", 4)).withColumn("p_value", F.round("p_value", 5)))


@query("ic_intervals")
def _(spark, d):
    return shown(inference.ic_inference(forecasts(spark, d), 12, "series").select("series", "ic", "ci_low", "ci_high"))


@query("legacy_sizes", f"WITH {FC} SELECT series, greatest(1, count(*) // 12) AS size FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series")
def _(spark, d):
    rows = evaluation.complete(forecasts(spark, d)).groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("series", inference.legacy_size(F.col("n"), 12).alias("size"))


_BOTH_IC = f"""WITH {FC}, h AS (SELECT series, period, actual, predicted AS revised, lag(predicted) OVER ({W_SQL}) AS realtime FROM fc), k AS (SELECT series, 'revised' AS kind, actual, revised AS p FROM h UNION ALL SELECT series, 'realtime', actual, realtime FROM h),
rk AS (SELECT series, kind, rank() OVER (PARTITION BY series, kind ORDER BY actual) + (count(*) OVER (PARTITION BY series, kind, actual) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series, kind ORDER BY p) + (count(*) OVER (PARTITION BY series, kind, p) - 1) / 2.0 AS p FROM k WHERE actual IS NOT NULL AND p IS NOT NULL),
ic AS (SELECT series, max(ic) FILTER (kind = 'revised') AS revised, max(ic) FILTER (kind = 'realtime') AS realtime FROM (SELECT series, kind, corr(a, p) AS ic FROM rk GROUP BY 1, 2) GROUP BY series)"""


def _both_ics(spark, d) -> DataFrame:
    """IC of a forecast and of what was known of it a period before."""
    f = forecasts(spark, d)
    late = f.withColumn("predicted", F.lag("predicted").over(w.by_series()))
    ic = lambda x, name: evaluation.information_coefficient(x, "series").select("series", F.col("ic").alias(name))
    return ic(f, "revised").join(ic(late, "realtime"), "series")


@query("revision_risk", f"{_BOTH_IC} SELECT series, round(revised, 6) AS revised, round(realtime, 6) AS realtime, round(CASE WHEN revised > 0 THEN (revised - realtime) / revised END, 6) AS risk, round(CASE WHEN abs(revised) > 1e-6 THEN (revised - realtime) / revised ELSE 0 END, 6) AS vintage_risk FROM ic")
def _(spark, d):
    r, t = F.col("revised"), F.col("realtime")
    return shown(_both_ics(spark, d).withColumn("risk", inference.revision_risk(r, t)).withColumn("vintage_risk", inference.vintage_revision_risk(r, t)))


IMPORTANCE = "im AS (SELECT p_type AS model, p_brand AS feature, avg(p_retailprice) AS revised, avg(p_size) AS realtime FROM part GROUP BY 1, 2)"


def _importances(spark, d, column: str) -> DataFrame:
    return panels.read(spark, d, "part").groupBy(F.col("p_type").alias("model"), F.col("p_brand").alias("feature")).agg(F.avg(column).alias("value"))


@query("feature_stability", f"WITH {IMPORTANCE}, k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY revised) + (count(*) OVER (PARTITION BY model, revised) - 1) / 2.0 AS a, rank() OVER (PARTITION BY model ORDER BY realtime) + (count(*) OVER (PARTITION BY model, realtime) - 1) / 2.0 AS b FROM im) SELECT model, count(*) AS features, CASE WHEN count(*) >= 3 THEN round(coalesce(corr(a, b), 0), 6) END AS stability FROM k GROUP BY model")
def _(spark, d):
    return shown(inference.feature_stability(_importances(spark, d, "p_retailprice"), _importances(spark, d, "p_size"), "model"))


@query("mean_importance", "WITH im AS (SELECT p_type AS model, p_size % 4 AS fold, p_brand AS feature, avg(p_retailprice) AS value FROM part GROUP BY 1, 2, 3), m AS (SELECT model, feature, avg(value) AS value FROM im GROUP BY 1, 2) SELECT model, feature, round(value, 6) AS value, round(value / sum(value) OVER (PARTITION BY model), 6) AS share, CAST(row_number() OVER (PARTITION BY model ORDER BY value DESC, feature) AS INTEGER) AS rank FROM m")
def _(spark, d):
    rows = panels.read(spark, d, "part").groupBy(F.col("p_type").alias("model"), (F.col("p_size") % 4).alias("fold"), F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("value"))
    return shown(inference.mean_importance(rows, "model"))


@query("dominance_alert", "WITH im AS (SELECT p_brand AS model, p_type AS feature, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p_brand) AS value FROM part WHERE p_size < 3 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY value DESC, feature DESC) AS r FROM im) SELECT model, feature, round(value, 6) AS value FROM k WHERE r = 1 AND value > 0.30")
def _(spark, d):
    rows = panels.read(spark, d, "part").filter("p_size < 3").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("model")))
    return shown(inference.dominance(rows, "model"))


@query(
    "deployability",
    "WITH m AS (SELECT p_partkey, (p_partkey % 300) / 1000 AS ic, (p_size % 50) / 100 AS risk, CASE WHEN p_size % 7 > 0 THEN (p_partkey % 97) / 96 END AS stability FROM part) SELECT p_partkey, ic > 0.15 AS ic_ok, risk < 0.30 AS risk_ok, coalesce(stability > 0.70, FALSE) AS stability_ok, ic > 0.15 AND risk < 0.30 AND coalesce(stability > 0.70, FALSE) AS deployable, CASE WHEN stability > 0.8 THEN 'Stable' WHEN stability > 0.5 THEN 'Marginal' ELSE 'Unstable' END AS label, CASE WHEN risk < 0.01 THEN '***' WHEN risk < 0.05 THEN '**' WHEN risk < 0.10 THEN '*' ELSE '' END AS stars FROM m",
)
def _(spark, d):
    p = panels.read(spark, d, "part")
    rows = p.select("p_partkey", ((F.col("p_partkey") % 300) / 1000).alias("ic"), ((F.col("p_size") % 50) / 100).alias("risk"), F.when(F.col("p_size") % 7 > 0, (F.col("p_partkey") % 97) / 96).alias("stability"))
    out = inference.deployable(rows).withColumn("label", inference.stability_label(F.col("stability"))).withColumn("stars", inference.stars(F.col("risk")))
    return out.drop("ic", "risk", "stability")


SELECTED = "sel AS (SELECT l_linenumber AS fold_id, l_linestatus || CAST(l_suppkey % 20 AS VARCHAR) AS feature FROM lineitem GROUP BY 1, 2 HAVING avg(l_quantity) > 25.4)"


def _selected(spark, d) -> DataFrame:
    rows = panels.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("fold_id"), F.concat("l_linestatus", (F.col("l_suppkey") % 20).cast("string")).alias("feature")).agg(F.avg("l_quantity").alias("q"))
    return rows.filter("q > 25.4").select("fold_id", "feature")


@query("selection_stability", f"WITH {SELECTED}, s AS (SELECT feature, count(DISTINCT fold_id) AS times FROM sel GROUP BY feature) SELECT feature, times, round(times / 7, 6) AS share, CASE WHEN times / 7 > 0.8 THEN 'Stable' WHEN times / 7 > 0.5 THEN 'Marginal' ELSE 'Unstable' END AS label, times = 7 AS always FROM s")
def _(spark, d):
    return shown(inference.selection_stability(_selected(spark, d), 7))


@query("selection_changes", f"WITH {SELECTED}, c AS (SELECT DISTINCT l_linestatus || CAST(l_suppkey % 20 AS VARCHAR) AS feature FROM lineitem), o AS (SELECT feature FROM sel WHERE fold_id = 1) SELECT feature, 'kept' AS part FROM c WHERE feature IN (SELECT feature FROM o) UNION ALL SELECT feature, 'dropped' FROM (SELECT feature FROM c EXCEPT SELECT feature FROM o)")
def _(spark, d):
    candidates = panels.read(spark, d, "lineitem").select(F.concat("l_linestatus", (F.col("l_suppkey") % 20).cast("string")).alias("feature")).distinct()
    kept, dropped = inference.selection_changes(_selected(spark, d).filter("fold_id = 1"), candidates)
    return kept.withColumn("part", F.lit("kept")).unionByName(dropped.withColumn("part", F.lit("dropped")))


TESTS = "t AS (SELECT p_brand || p_size AS test_id, round(least(1, (avg(p_retailprice) % 100) / 100 * CASE WHEN min(p_partkey) % 3 = 0 THEN 0.002 ELSE 1 END), 9) AS p FROM part GROUP BY p_brand, p_size)"


@query(
    "correction_detail",
    f"""WITH {TESTS}, k AS (SELECT p, row_number() OVER (ORDER BY p, test_id) AS k, count(*) OVER () AS m FROM t), q AS (SELECT *, NOT bool_or(p >= 0.05 / (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS holm, max(CASE WHEN p <= k / m * 0.10 THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS bh FROM k),
u AS (SELECT 'none' AS method, 0.05::DOUBLE AS level, p, p < 0.05 AS hit FROM q UNION ALL SELECT 'bonferroni', 0.05, p, p < 0.05 / m FROM q UNION ALL SELECT 'holm', 0.05, p, holm FROM q UNION ALL SELECT 'benjamini_hochberg', 0.10, p, bh FROM q)
SELECT method, level, count(*) AS tests, count(*) FILTER (hit) AS rejected, round(min(p), 6) AS least_p, round(max(p) FILTER (hit), 6) AS most_p_rejected FROM u GROUP BY method, level""",
)
def _(spark, d):
    p = F.avg("p_retailprice") % 100 / 100 * F.when(F.min("p_partkey") % 3 == 0, 0.002).otherwise(1.0)
    tests = panels.read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.least(F.lit(1.0), p), 9).alias("p_value")).select(F.concat("p_brand", F.col("p_size").cast("string")).alias("test_id"), "p_value")
    return shown(inference.correction_detail(tests))


def _benchmark_sql() -> str:
    rows = ", ".join(f"('{n}', {', '.join(map(str, v))})" for n, v in evaluation.RATINGS.items())
    return f"""WITH l(c, e, g, a, m, s) AS (VALUES {rows}), i AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 300) / 1000 - 0.05 END AS ic FROM part)
SELECT p_partkey, c AS asset_class, round(ic, 6) AS ic, CASE WHEN ic >= e THEN 'excellent' WHEN ic >= g THEN 'good' WHEN ic >= a THEN 'acceptable' WHEN ic >= m THEN 'marginal' ELSE 'poor' END AS rating, ic > s AS suspicious, round(CASE WHEN ic IS NULL THEN 0 ELSE greatest(0, ic * sqrt(24) - 0.004 * sqrt(12)) END, 6) AS sharpe, round(ic * sqrt(12), 6) AS naive_sharpe,
  concat_ws('; ', CASE WHEN ic > s THEN 'suspiciously high' END, CASE WHEN ic < m OR ic IS NULL THEN 'below the minimum' END, CASE WHEN ic < 0 THEN 'negative' END, CASE WHEN ic IS NULL THEN 'missing' END) AS warnings FROM i, l"""


@query("benchmark_table", _benchmark_sql())
def _(spark, d):
    ic = F.when(F.col("p_partkey") % 11 > 0, (F.col("p_partkey") % 300) / 1000 - 0.05)
    rows = panels.read(spark, d, "part").select("p_partkey", ic.alias("ic"), F.explode(F.array(*[F.lit(n) for n in evaluation.RATINGS])).alias("asset_class"))
    return shown(inference.benchmark(rows))


@query("weighted_ensemble", f"WITH {MODELS}, wt(model, weight) AS (VALUES ('naive', 0.4737), ('reverse', 0.2113), ('drift', 0.3151)) SELECT CAST(period AS VARCHAR) AS period, round(sum(weight * predicted) / sum(weight), 6) AS predicted, round(max(actual), 6) AS actual FROM ml JOIN wt USING (model) WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY period")
def _(spark, d):
    weights = spark.createDataFrame([("naive", 0.4737), ("reverse", 0.2113), ("drift", 0.3151)], "model string, weight double")
    return shown(inference.weighted_ensemble(models(spark, d), weights))


@query(
    "quintile_monotonicity",
    f"""WITH {FC}, k AS (SELECT series, actual, row_number() OVER (PARTITION BY series ORDER BY predicted, period) AS rk, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL),
b AS (SELECT series, CAST(greatest(1, ceil((rk - 1) * 5 / (n - 1))) AS INTEGER) AS bin, avg(actual) AS m FROM k GROUP BY 1, 2), r AS (SELECT series, bin, m, rank() OVER (PARTITION BY series ORDER BY m) AS mr FROM b)
SELECT series, round(max(m) FILTER (bin = 5) - max(m) FILTER (bin = 1), 6) AS spread, round(corr(bin, mr), 6) AS monotonicity FROM r GROUP BY series""",
)
def _(spark, d):
    return shown(inference.monotonicity(preprocess.quintile_spread(forecasts(spark, d)), 5, "series"))


# ---- features


@query(
    "scale_robust_pit",
    f"""WITH {PD}, s AS (SELECT *, CASE WHEN count(value) OVER o >= 6 THEN quantile_cont(value, 0.5) OVER o END AS m, CASE WHEN count(value) OVER o >= 6 THEN quantile_cont(value, 0.75) OVER o - quantile_cont(value, 0.25) OVER o END AS q FROM pm_d WINDOW o AS ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first_value(m IGNORE NULLS) OVER n AS m1, first_value(CASE WHEN q = 0 THEN 1 ELSE q END IGNORE NULLS) OVER n AS q1 FROM s WINDOW n AS ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT CAST(period AS VARCHAR) AS period, series, round(coalesce((value - m1) / q1, 0), 6) AS value FROM f""",
)
def _(spark, d):
    return shown(preprocess.scale_expanding(pm(spark, d), 6, "bfill", "robust"))


@query(
    "scale_rolling_pit",
    f"""WITH {PD}, s AS (SELECT *, CASE WHEN count(value) OVER o >= 6 THEN avg(value) OVER o END AS m, CASE WHEN count(value) OVER o >= 6 THEN stddev_samp(value) OVER o END AS q FROM pm_d WINDOW o AS ({W_SQL} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT CAST(period AS VARCHAR) AS period, series, round((value - m) / CASE WHEN q = 0 THEN 1 ELSE q END, 6) AS value FROM s""",
)
def _(spark, d):
    return shown(preprocess.scale_expanding(pm(spark, d), 6, "null", "standard", 12))


@query(
    "inverse_second_differences",
    f"""WITH {PW}, x AS (SELECT period, value, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d3, ln(value) - 2 * ln(lag(value) OVER w) + ln(lag(value, 2) OVER w) AS d6, first_value(value) OVER w AS f, nth_value(value, 2) OVER w AS g, row_number() OVER w AS rn FROM pw WINDOW w AS (ORDER BY period)),
y AS (SELECT *, CASE WHEN rn > 1 THEN coalesce(sum(d3) OVER o, 0) + g - f END AS s3, CASE WHEN rn > 1 THEN coalesce(sum(d6) OVER o, 0) + ln(g) - ln(f) END AS s6 FROM x WINDOW o AS (ORDER BY period))
SELECT CAST(period AS VARCHAR) AS period, round(f + coalesce(sum(s3) OVER o, 0), 4) AS back3, round(exp(ln(f) + coalesce(sum(s6) OVER o, 0)), 4) AS back6, round(value, 4) AS value FROM y WINDOW o AS (ORDER BY period)""",
)
def _(spark, d):
    p, out = pw(spark, d), None
    for code in (3, 6):
        coded = transforms.transform(p, p.select("series").distinct().withColumn("code", F.lit(code)))
        part = transforms.inverse(coded, code).select("period", F.col("back").alias(f"back{code}"))
        out = part if out is None else out.join(part, "period")
    return shown(out.join(p.select("period", "value"), "period"), 4)


NAMES = {"1-URGENT": "BAA", "2-HIGH": "AAA", "3-MEDIUM": "GS10", "4-NOT SPECIFIED": "TB3MS", "5-LOW": "INDPRO"}


def _definitions_sql() -> str:
    found = {name: (a, b, kind) for group in transforms.SPREADS.values() for a, b, name in group for kind in ["diff"]}
    found |= {name: (a, b, kind) for group in transforms.RATIOS.values() for a, b, name, kind in group}
    rows = ", ".join(f"('{name}', '{a}', '{b}', '{kind}')" for name, (a, b, kind) in found.items())
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())
    return f"""WITH {PD}, n AS (SELECT period, CASE series {names} END AS series, value FROM pm_d), df(name, a, b, kind) AS (VALUES {rows})
SELECT CAST(x.period AS VARCHAR) AS period, name AS series, round(CASE WHEN kind = 'log' THEN CASE WHEN x.value / nullif(y.value, 0) > 0 THEN ln(x.value / nullif(y.value, 0)) END ELSE x.value - y.value END, 4) AS value FROM df JOIN n x ON x.series = df.a JOIN n y ON y.series = df.b AND y.period = x.period"""


@query("default_ratios", _definitions_sql())
def _(spark, d):
    named = pm(spark, d).replace(NAMES, subset=["series"])
    return shown(transforms.pairs(named, transforms.definitions(spark)), 4)


@query("level_projection", f"WITH {LD}, k AS (SELECT DISTINCT series, CASE WHEN series IN ('AF', 'RF') THEN 1 ELSE 5 END AS code FROM lm_d) SELECT CAST(period AS VARCHAR) AS period, series || '_level' AS series, round(value, 4) AS value FROM lm_d JOIN k USING (series) WHERE code = 1")
def _(spark, d):
    panel = lm(spark, d)
    codes = panel.select("series").distinct().withColumn("code", F.when(F.col("series").isin("AF", "RF"), 1).otherwise(5))
    return shown(transforms.levels(panel, codes), 4)


@query("drop_levels", f"WITH {LD}, u AS (SELECT period, series AS feature, value FROM lm_d UNION ALL SELECT period, series || '_level', value FROM lm_d) SELECT CAST(period AS VARCHAR) AS period, feature, round(value, 4) AS value FROM u WHERE feature NOT LIKE '%\\_level' ESCAPE '\\'")
def _(spark, d):
    panel = lm(spark, d).withColumnRenamed("series", "feature")
    both = panel.unionByName(panel.withColumn("feature", F.concat("feature", F.lit("_level"))))
    return shown(transforms.without_levels(both.select("period", "feature", "value")), 4)


@query("outer_concat", f"WITH {PD}, {LD}, a AS (SELECT period, max(value) FILTER (series = '5-LOW') AS low FROM pm_d GROUP BY period), b AS (SELECT period, max(value) FILTER (series = 'AF') AS af FROM lm_d WHERE month(period) > 3 GROUP BY period) SELECT CAST(coalesce(a.period, b.period) AS VARCHAR) AS period, round(low, 2) AS low, round(af, 4) AS af FROM a FULL JOIN b ON a.period = b.period")
def _(spark, d):
    a = pm(spark, d).groupBy("period").pivot("series", ["5-LOW"]).agg(F.max("value")).withColumnRenamed("5-LOW", "low")
    b = lm(spark, d).filter("month(period) > 3").groupBy("period").pivot("series", ["AF"]).agg(F.max("value")).withColumnRenamed("AF", "af")
    return shown(a.join(b, "period", "full"), 4)


@query("needed_series", "SELECT DISTINCT s FROM (SELECT l_linestatus AS s FROM lineitem UNION SELECT l_returnflag FROM lineitem UNION SELECT o_orderpriority FROM orders)")
def _(spark, d):
    a, o = panels.read(spark, d, "lineitem"), panels.read(spark, d, "orders")
    return a.select(F.col("l_linestatus").alias("s")).distinct().union(a.select("l_returnflag").distinct()).union(o.select("o_orderpriority").distinct()).distinct()


@query(
    "representative_modes",
    f"""WITH {PD}, c(series, cluster) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 2), ('5-LOW', 3)), x AS (SELECT cluster, period, count(value) = count(*) AS whole FROM pm_d JOIN c USING (series) GROUP BY 1, 2), n AS (SELECT cluster, count(*) FILTER (whole) AS n FROM x GROUP BY 1),
s AS (SELECT cluster, series, var_samp(value) AS v FROM pm_d JOIN c USING (series) JOIN x USING (cluster, period) WHERE whole GROUP BY 1, 2) SELECT cluster, CASE WHEN count(*) = 1 OR any_value(n) < 20 THEN min(series) ELSE arg_max(series, v) END AS series FROM s JOIN n USING (cluster) GROUP BY cluster""",
)
def _(spark, d):
    rows = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 1), ("3-MEDIUM", 2), ("4-NOT SPECIFIED", 2), ("5-LOW", 3)], "feature string, cluster int")
    return validation.representatives(pm(spark, d), rows, "auto", least=20)


@query("safe_target", f"WITH {PW}, s AS (SELECT period, lag(value, 8) OVER (ORDER BY period) AS value FROM pw) SELECT CAST(period AS VARCHAR) AS period, round(value, 4) AS value, 'shifted' AS how FROM s WHERE value IS NOT NULL UNION ALL SELECT CAST(period AS VARCHAR), round(value, 4), 'before' FROM pw WHERE period < DATE '1997-01-01' AND value IS NOT NULL")
def _(spark, d):
    p = pw(spark, d).select("period", "value")
    a, b = inference.safe_target(p, 8, None, 10), inference.safe_target(p, 24, "1999-01-01", 10)
    return shown(a.withColumn("how", F.lit("shifted")).unionByName(b.withColumn("how", F.lit("before"))), 4)


@query(
    "sequence_validation",
    f"""WITH {PD}, s AS (SELECT series, count(value) OVER k AS c, count(*) OVER k AS n, row_number() OVER ({W_SQL}) AS rn FROM pm_d WINDOW k AS ({W_SQL} ROWS 11 PRECEDING)), g AS (SELECT series, count(*) AS rows, greatest(0, (count(*) - 12) // 3 + 1) AS possible, count(*) FILTER (n = 12 AND c = 12 AND (rn - 12) % 3 = 0) AS usable FROM s GROUP BY series)
SELECT series, rows, possible, usable, usable >= 30 AS valid, CASE WHEN usable < 30 THEN 'Total sequences ' || usable || ' below 30' END AS reason FROM g""",
)
def _(spark, d):
    return inference.validate_sequences(pm(spark, d), inference.sequence_length("adaptive", 24), 3, 30)


@query("sequence_values", f"WITH {PD}, s AS (SELECT series, period, list(value) FILTER (value IS NOT NULL) OVER k AS vs, row_number() OVER ({W_SQL}) AS rn FROM pm_d WINDOW k AS ({W_SQL} ROWS 5 PRECEDING)) SELECT series, CAST(period AS VARCHAR) AS period, round(vs[1], 2) AS first, round(list_sum(vs), 2) AS total FROM s WHERE rn >= 6 AND (rn - 6) % 2 = 0 AND len(vs) = 6")
def _(spark, d):
    out = inference.sequences(pm(spark, d), 6, 2)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return shown(out.select("series", "period", F.col("values")[0].alias("first"), total.alias("total")), 2)


@query("vintage_dates", "SELECT CAST(last_day(m) AS VARCHAR) AS vintage, every FROM (SELECT unnest(range(DATE '2000-01-01', DATE '2024-07-01', INTERVAL 1 MONTH)) AS m), (VALUES ('half-year', 6), ('quarter', 3)) v(every, k) WHERE month(m) % k = 0")
def _(spark, d):
    parts = [align.vintage_dates(spark, "2000-01-01", "2024-07-01", k).withColumn("every", F.lit(name)) for name, k in (("half-year", 6), ("quarter", 3))]
    return shown(parts[0].unionByName(parts[1]))


# ---- models


@query("ridge_closed_form", f"""WITH {PW}, f AS (SELECT value - lag(value, 3) OVER w AS x, ln(lead(value, 4) OVER w / value) AS y FROM pw WINDOW w AS (ORDER BY period)), m AS (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my, stddev_pop(x) OVER () AS s FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT 'x' AS feature, round(sum((x - mx) / s * (y - my)) / (sum(((x - mx) / s) ** 2) + 1), 6) AS coefficient, count(*) AS n FROM m""")
def _(spark, d):
    """Ridge on a standardised feature, by the grouped learner."""
    p = pw(spark, d)
    data = p.select(F.lit("all").alias("k"), "period", (F.col("value") - transforms.lag(F.col("value"), 3)).alias("x"), F.log(F.lead("value", 4).over(w.by_series()) / F.col("value")).alias("y"))
    out = learners.coefficients(data.dropna(subset=["x", "y"]), ["x"], "ridge", ("k",), alpha=1.0)
    return shown(out.select("feature", "coefficient", "n"))


def _design(spark, d) -> tuple[DataFrame, list[str]]:
    p = pw(spark, d)
    names = [f"price_{k}_{n}M" for n in (3, 6) for k in ("chg", "zscore")]
    from tidalpanel.operators import models as models_

    target = p.select("period", F.log(F.lead("value", 4).over(w.by_series()) / F.col("value")).alias("y"))
    return models_.wide(transforms.momentum(p, (3, 6)), names).join(target, "period"), names


@query("grouped_tournament")
def _(spark, d):
    data, names = _design(spark, d)
    out = learners.tournament(data, names, ("ridge", "lasso", "elastic_net", "mlp", "vecm"), train=36, validate=12, step=12)
    return shown(learners.leaderboard(out), 4)


@query("regime_classifier")
def _(spark, d):
    data, names = _design(spark, d)
    return shown(learners.classify(data, names, "2001-01-01").select("period", "bullish", "probability"), 4)


@query("vintage_validation")
def _(spark, d):
    """Each vintage's forecast by a model fitted on what the first vintage knew."""
    return shown(learners.vintage_loop(validation.truncated(lm(spark, d)), ("AF", "NO", "RF"), "AF"), 4)


@query("linear_shap")
def _(spark, d):
    data, names = _design(spark, d)
    return shown(learners.contributions(data, names, "ridge").groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs")), 6)


# ---- reporting extras


@query("grouping_sets", "SELECT l_linestatus, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus), ())")
def _(spark, d):
    rows = panels.read(spark, d, "lineitem")
    return rows.rollup("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("approximate_counts")
def _(spark, d):
    rows = panels.read(spark, d, "lineitem")
    return rows.groupBy("l_linestatus").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"))
