"""All registered queries of the panel engine, with their DuckDB text.

Every query reads its whole tables. Periods are returned as text and doubles are rounded,
so that both engines' results compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators import align, evaluation, inference, learners, preprocess, stats, transforms, validation
from tidalpanel.operators import models as models_
from tidalpanel.plans import panels
from tidalpanel.plans.panels import dense_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ic_by_series"



def v():
    return F.col("value")


W_SQL = "PARTITION BY series ORDER BY period"
PD, LD, ED = dense_sql("pm"), dense_sql("lm"), dense_sql("ed")
PW = panels.SQL["pw"]


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return put


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, doubles rounded."""
    kinds = dict(df.dtypes)
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.round(F.col(c), digits)
    return df.select(*[(text(c) if kinds[c] == "date" else number(c) if kinds[c] == "double" else F.col(c)).alias(c) for c in df.columns])


def pm(spark, d):
    return panels.densify(panels.orders_month(spark, d))


def lm(spark, d):
    return panels.densify(panels.lineitem_month(spark, d))


def ed(spark, d):
    return panels.densify(panels.events_day(spark, d))


def pw(spark, d):
    return panels.price_week(spark, d)


# ---- panels and transforms


@query("orders_month_panel", f"WITH {PD} SELECT CAST(period AS VARCHAR) AS period, series, round(value, 2) AS value FROM pm_d")
def _(spark, d):
    return shown(pm(spark, d), 2)


@query("events_day_panel", f"WITH {ED} SELECT CAST(period AS VARCHAR) AS period, series, value FROM ed_d")
def _(spark, d):
    return shown(ed(spark, d))


CODES_SQL = f"""WITH {PD}, c AS (SELECT unnest(range(1, 8)) AS code), s AS (
  SELECT series || '|' || code AS series, CAST(code AS INTEGER) AS code, period, value - 2000000 * (code % 2) AS value FROM pm_d CROSS JOIN c
), l AS (
  SELECT *, CASE WHEN value > 0 THEN ln(value) WHEN value < 0 THEN ln(1e-10) END AS ln, last_value(value IGNORE NULLS) OVER ({W_SQL}) AS f FROM s
), o AS (
  SELECT *, CASE code WHEN 2 THEN value - lag(value) OVER w WHEN 3 THEN value - 2 * lag(value) OVER w + lag(value, 2) OVER w WHEN 4 THEN ln WHEN 5 THEN ln - lag(ln) OVER w
    WHEN 6 THEN ln - 2 * lag(ln) OVER w + lag(ln, 2) OVER w WHEN 7 THEN f / nullif(lag(f) OVER w, 0) - 1 ELSE value END AS out FROM l WINDOW w AS ({W_SQL})
) SELECT CAST(period AS VARCHAR) AS period, series, code, round(out, 4) AS out FROM o"""


@query("transform_codes_1_7", CODES_SQL)
def _(spark, d):
    rows = pm(spark, d).withColumn("code", F.explode(F.array(*[F.lit(k) for k in range(1, 8)])))
    rows = rows.select("period", F.concat_ws("|", "series", F.col("code").cast("string")).alias("series"), (v() - 2000000 * (F.col("code") % 2)).alias("value"))
    codes = rows.select("series").distinct().withColumn("code", F.split("series", r"\|")[1].cast("int"))
    return shown(transforms.transform(rows, codes).select("period", "series", "code", "out"), 4)


@query(
    "transform_inverse",
    f"""WITH {PW}, x AS (SELECT period, value, value - lag(value) OVER w AS d2, ln(value) - ln(lag(value) OVER w) AS d5, value / lag(value) OVER w - 1 AS d7, first_value(value) OVER w AS f FROM pw WINDOW w AS (ORDER BY period))
SELECT CAST(period AS VARCHAR) AS period, round(f + coalesce(sum(d2) OVER o, 0), 4) AS back2, round(f * exp(coalesce(sum(d5) OVER o, 0)), 4) AS back5, round(f * exp(coalesce(sum(ln(1 + d7)) OVER o, 0)), 4) AS back7, round(value, 4) AS value FROM x WINDOW o AS (ORDER BY period)""",
)
def _(spark, d):
    p = pw(spark, d)
    out = None
    for code in (2, 5, 7):
        coded = transforms.transform(p, p.select("series").distinct().withColumn("code", F.lit(code)))
        part = transforms.inverse(coded, code).select("period", F.col("back").alias(f"back{code}"))
        out = part if out is None else out.join(part, "period")
    return shown(out.join(p.select("period", "value"), "period"), 4)


@query("pct_change_ffill", f"WITH {PD}, f AS (SELECT *, last_value(value IGNORE NULLS) OVER ({W_SQL}) AS f FROM pm_d) SELECT CAST(period AS VARCHAR) AS period, series, round(f / nullif(lag(f) OVER ({W_SQL}), 0) - 1, 6) AS change FROM f")
def _(spark, d):
    rows = pm(spark, d).withColumn("f", w.forward_fill(v()))
    return shown(rows.select("period", "series", (F.col("f") / w.nonzero(transforms.lag(F.col("f"))) - 1).alias("change")))


@query(
    "growth_acceleration_momentum",
    f"""WITH {PW}, x AS (SELECT *, ln(value) AS l FROM pw) SELECT CAST(period AS VARCHAR) AS period, round(ln(value / lag(value, 4) OVER w) * 52 / 4, 6) AS growth, round(l - 2 * lag(l, 3) OVER w + lag(l, 6) OVER w, 6) AS accel,
  round(CASE WHEN count(value) OVER s >= 3 THEN avg(value) OVER s END - CASE WHEN count(value) OVER n >= 12 THEN avg(value) OVER n END, 6) AS ma, round((value - lag(value, 6) OVER w) / nullif(abs(lag(value, 6) OVER w), 0), 6) AS roc
FROM x WINDOW w AS (ORDER BY period), s AS (ORDER BY period ROWS 2 PRECEDING), n AS (ORDER BY period ROWS 11 PRECEDING)""",
)
def _(spark, d):
    return shown(
        pw(spark, d).select(
            "period", transforms.growth(v(), 4, 52).alias("growth"), transforms.log_acceleration(v(), 3).alias("accel"), transforms.moving_average_momentum(v()).alias("ma"), transforms.rate_of_change(v(), 6).alias("roc")
        )
    )


@query("yoy_inflation", f"WITH {LD} SELECT CAST(period AS VARCHAR) AS period, series, round((value / nullif(lag(value, 12) OVER ({W_SQL}), 0) - 1) * 100, 6) AS yoy FROM lm_d")
def _(spark, d):
    return shown(lm(spark, d).select("period", "series", transforms.year_on_year(v()).alias("yoy")))


PAIRS = [("AF_RF", "AF", "RF", "log"), ("NO_AF", "NO", "AF", "log"), ("NO_RF", "NO", "RF", "diff"), ("AF_NO", "AF", "NO", "diff"), ("absent", "AF", "ZZ", "log")]
PAIRS_CTE = "d(name, l, r, kind) AS (VALUES " + ", ".join(str(p) for p in PAIRS) + "), q AS (SELECT a.period, d.name AS series, CASE WHEN kind = 'log' THEN CASE WHEN a.value / nullif(b.value, 0) > 0 THEN ln(a.value / nullif(b.value, 0)) END ELSE a.value - b.value END AS value FROM d JOIN lm_d a ON a.series = d.l JOIN lm_d b ON b.series = d.r AND b.period = a.period)"


def ratio_panel(spark, d):
    return transforms.pairs(lm(spark, d), spark.createDataFrame(PAIRS, "name string, left string, right string, kind string"))


@query("log_ratios_and_spreads", f"WITH {LD}, {PAIRS_CTE} SELECT CAST(period AS VARCHAR) AS period, series, round(value, 6) AS value FROM q")
def _(spark, d):
    return shown(ratio_panel(spark, d))


@query(
    "ratio_changes",
    f"WITH {LD}, {PAIRS_CTE}, k AS (SELECT unnest([1, 3, 6, 12]) AS k), x AS (SELECT period, series || '_chg_' || k || 'M' AS feature, value - lag(value, k) OVER (PARTITION BY series, k ORDER BY period) AS value FROM q CROSS JOIN k) SELECT CAST(period AS VARCHAR) AS period, feature, round(value, 6) AS value FROM x",
)
def _(spark, d):
    return shown(transforms.changes(ratio_panel(spark, d)))


def _momentum_sql() -> str:
    parts = []
    for n in transforms.MOMENTUM:
        r = f"({W_SQL} ROWS {n - 1} PRECEDING)"
        parts += [
            f"SELECT period, series || '_chg_{n}M' AS feature, value - lag(value, {n}) OVER ({W_SQL}) AS value FROM lm_d",
            f"SELECT period, series || '_accel_{n}M', value - 2 * lag(value, {n}) OVER ({W_SQL}) + lag(value, {2 * n}) OVER ({W_SQL}) FROM lm_d",
            f"SELECT period, series || '_zscore_{n}M', CASE WHEN count(value) OVER {r} >= {min(n, 12)} THEN (value - avg(value) OVER {r}) / nullif(stddev_samp(value) OVER {r}, 0) END FROM lm_d",
        ]
    return f"WITH {LD}, x AS ({' UNION ALL '.join(parts)}) SELECT CAST(period AS VARCHAR) AS period, feature, round(value, 4) AS value FROM x"


@query("momentum_block", _momentum_sql())
def _(spark, d):
    return shown(transforms.momentum(lm(spark, d)), 4)


def _standard_sql(kind: str) -> str:
    x, r = f"({W_SQL} ROWS UNBOUNDED PRECEDING)", f"({W_SQL} ROWS 6 PRECEDING)"
    cell = {
        "zscore": lambda o, n: f"CASE WHEN count(value) OVER {o} >= {max(2, n)} THEN (value - avg(value) OVER {o}) / nullif(stddev_samp(value) OVER {o}, 0) END",
        "minmax": lambda o, n: f"CASE WHEN count(value) OVER {o} >= {n} THEN (value - min(value) OVER {o}) / nullif(max(value) OVER {o} - min(value) OVER {o}, 0) END",
        "robust": lambda o, n: f"CASE WHEN count(value) OVER {o} >= {n} THEN (value - quantile_cont(value, 0.5) OVER {o}) / nullif(quantile_cont(value, 0.75) OVER {o} - quantile_cont(value, 0.25) OVER {o}, 0) END",
    }[kind]
    return f"WITH {ED} SELECT CAST(period AS VARCHAR) AS period, series, round({cell(x, 1)}, 6) AS expanding, round({cell(r, 7)}, 6) AS rolling FROM ed_d"


def _standard(kind):
    def run(spark, d):
        f = {"zscore": w.zscore, "minmax": w.minmax, "robust": w.robust}[kind]
        return shown(ed(spark, d).select("period", "series", f(v(), w.expanding(), 2 if kind == "zscore" else 1).alias("expanding"), f(v(), w.rolling(7), 7).alias("rolling")))

    return run


for _kind in ("zscore", "minmax", "robust"):
    query(f"{_kind}_windows", _standard_sql(_kind))(_standard(_kind))

HISTORY = f"SELECT a.period, a.series, a.value, count(b.value) AS n, count(*) FILTER (b.value < a.value) AS lt, count(*) FILTER (b.value = a.value) AS eq FROM %s a LEFT JOIN %s b ON a.series = b.series AND b.period <= a.period GROUP BY 1, 2, 3"


@query("percentile_rank_expanding", f"WITH {ED}, h AS ({HISTORY % ('ed_d', 'ed_d')}) SELECT CAST(period AS VARCHAR) AS period, series, round(CASE WHEN value IS NOT NULL AND n > 1 THEN (lt + (eq + 1) / 2.0 - 1) / (n - 1) * 100 END, 6) AS pct FROM h")
def _(spark, d):
    return shown(ed(spark, d).select("period", "series", w.percentile_rank(v()).alias("pct")))


QUINTILE = "CASE WHEN value IS NOT NULL AND n >= 20 THEN CAST(least(5, greatest(1, floor(lt / (n - 1) * 5) + 1)) AS INTEGER) END"


@query("quintile_expanding", f"WITH {ED}, h AS ({HISTORY % ('ed_d', 'ed_d')}), q AS (SELECT *, {QUINTILE} AS q FROM h) SELECT CAST(period AS VARCHAR) AS period, series, q AS quintile, " + ", ".join(f"CAST(q = {k} AS DOUBLE) AS q{k}" for k in range(1, 6)) + " FROM q")
def _(spark, d):
    out = preprocess.quintile_features(ed(spark, d), 20)
    return shown(out.select("period", "series", "quintile", *[F.col(f"Q{k}").alias(f"q{k}") for k in range(1, 6)]))


@query("drawdown_volatility", f"WITH {PW}, x AS (SELECT *, max(value) OVER o AS top, ln(value / lag(value) OVER (ORDER BY period)) AS r FROM pw WINDOW o AS (ORDER BY period)) SELECT CAST(period AS VARCHAR) AS period, round((value - top) / nullif(top, 0), 6) AS drawdown, round(CASE WHEN count(r) OVER k >= 6 THEN stddev_samp(r) OVER k * sqrt(12) END, 6) AS vol FROM x WINDOW k AS (ORDER BY period ROWS 5 PRECEDING)")
def _(spark, d):
    rows = pw(spark, d).withColumn("r", transforms.returns(v()))
    return shown(rows.select("period", w.drawdown(v()).alias("drawdown"), (w.sd(F.col("r"), w.rolling(6), 6) * 12**0.5).alias("vol")))


# ---- preprocessing

SPLIT = "2024-01-20"


@query(
    "quintile_fit_transform",
    f"""WITH {ED}, e AS (SELECT series, quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM ed_d WHERE period < DATE '{SPLIT}' AND value IS NOT NULL GROUP BY series),
x AS (SELECT d.*, CASE WHEN value BETWEEN e[1] AND e[6] THEN greatest(1, CAST(value > e[1] AS INT) + CAST(value > e[2] AS INT) + CAST(value > e[3] AS INT) + CAST(value > e[4] AS INT) + CAST(value > e[5] AS INT)) END AS b FROM ed_d d LEFT JOIN e USING (series))
SELECT CAST(period AS VARCHAR) AS period, series, value, """ + ", ".join(f"CAST(coalesce(b = {k}, FALSE) AS INTEGER) AS q{k}" for k in range(1, 6)) + " FROM x",
)
def _(spark, d):
    panel = ed(spark, d)
    out = preprocess.apply_quintiles(panel, preprocess.fit_quintiles(panel.filter(f"period < date '{SPLIT}'")))
    return shown(out.select("period", "series", "value", *[F.col(f"Q{k}").alias(f"q{k}") for k in range(1, 6)]))


FC = f"""{PD}, x AS (SELECT *, CASE WHEN value > 0 THEN ln(value) END - lag(CASE WHEN value > 0 THEN ln(value) END) OVER ({W_SQL}) AS g FROM pm_d), fc AS (
  SELECT period, series, round(lead(g) OVER ({W_SQL}), 6) AS actual, round(g, 6) AS predicted FROM x)"""


def forecasts(spark, d):
    """The naive forecast: the growth of this month for the next."""
    rows = pm(spark, d).withColumn("g", transforms.safe_log(v()) - transforms.lag(transforms.safe_log(v())))
    return rows.select("period", "series", F.round(F.lead("g").over(w.by_series()), 6).alias("actual"), F.round("g", 6).alias("predicted"))


@query(
    "quintile_spread",
    f"WITH {FC}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY predicted, period) AS rk, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL) SELECT series, CAST(greatest(1, ceil((rk - 1) * 5 / (n - 1))) AS INTEGER) AS bin, round(avg(actual), 6) AS mean_actual, count(*) AS n FROM r GROUP BY 1, 2",
)
def _(spark, d):
    return shown(preprocess.quintile_spread(forecasts(spark, d)))


@query("impute_expanding_median", f"WITH {PD} SELECT CAST(period AS VARCHAR) AS period, series, round(coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS value FROM pm_d")
def _(spark, d):
    return shown(preprocess.impute_expanding(pm(spark, d)), 2)


STATS = "st AS (SELECT series, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, count(value) AS n, var_samp(value) AS v, count(*) AS n_rows FROM %s GROUP BY series)"


@query("impute_fit_apply", f"WITH {PD}, {STATS % 'pm_d'} SELECT CAST(period AS VARCHAR) AS period, series, round(coalesce(value, med), 2) AS median, round(coalesce(value, m), 2) AS mean, round(coalesce(value, 0), 2) AS zero FROM pm_d JOIN st USING (series)")
def _(spark, d):
    panel = pm(spark, d)
    fitted, out = preprocess.statistics(panel), None
    for how in ("median", "mean", "zero"):
        part = preprocess.impute(panel, fitted, how).withColumnRenamed("value", how)
        out = part if out is None else out.join(part, ["period", "series"])
    return shown(out, 2)


@query("scale_fixed", f"WITH {ED}, {STATS % 'ed_d'} SELECT CAST(period AS VARCHAR) AS period, series, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS standard, round((value - med) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END, 6) AS robust FROM ed_d JOIN st USING (series)")
def _(spark, d):
    panel = ed(spark, d)
    fitted = preprocess.statistics(panel)
    a, b = preprocess.scale(panel, fitted).withColumnRenamed("value", "standard"), preprocess.scale(panel, fitted, "robust").withColumnRenamed("value", "robust")
    return shown(a.join(b, ["period", "series"]))


PAST = "(PARTITION BY series ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "scale_expanding_pit",
    f"""WITH {LD}, p AS (SELECT *, CASE WHEN count(value) OVER {PAST} >= 36 THEN avg(value) OVER {PAST} END AS m, CASE WHEN count(value) OVER {PAST} >= 36 THEN stddev_samp(value) OVER {PAST} END AS s FROM lm_d),
b AS (SELECT period, series, value, first_value(m IGNORE NULLS) OVER f AS m, first_value(CASE WHEN s = 0 THEN 1 ELSE s END IGNORE NULLS) OVER f AS s FROM p WINDOW f AS (PARTITION BY series ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT CAST(period AS VARCHAR) AS period, series, round(coalesce((value - m) / s, 0), 6) AS value FROM b""",
)
def _(spark, d):
    return shown(preprocess.scale_expanding(lm(spark, d)))


@query("column_report", f"WITH {PD}, {STATS % 'pm_d'} SELECT series, n, n_rows - n AS nulls, round((n_rows - n) * 100.0 / n_rows, 2) AS null_pct, round(m, 2) AS mean, round(s, 2) AS sd, round(med, 2) AS median FROM st")
def _(spark, d):
    s = preprocess.statistics(pm(spark, d))
    return shown(s.select("series", "n", (F.col("rows") - F.col("n")).alias("nulls"), ((F.col("rows") - F.col("n")) * 100.0 / F.col("rows")).alias("null_pct"), "mean", "sd", "median"), 2)


@query("dof_prune", f"WITH {PD}, {STATS % 'pm_d'} SELECT series, n, 23 - n AS gaps FROM st WHERE n > 0 AND v > 0 ORDER BY 23 - n, v DESC, series LIMIT 3")
def _(spark, d):
    return preprocess.prune(preprocess.statistics(pm(spark, d)), 23).select("series", "n", "gaps")


@query(
    "required_features",
    f"WITH {PD}, f(series) AS (VALUES ('1-URGENT'), ('5-LOW'), ('none')), g AS (SELECT p.period, f.series, x.value FROM (SELECT DISTINCT period FROM pm_d) p CROSS JOIN f LEFT JOIN pm_d x ON x.period = p.period AND x.series = f.series) SELECT CAST(period AS VARCHAR) AS period, series, coalesce(last_value(value IGNORE NULLS) OVER ({W_SQL}), 0) AS value FROM g",
)
def _(spark, d):
    return shown(preprocess.required(pm(spark, d), spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("none",)], "series string")), 2)


@query("first_by_priority", f"WITH {PD}, u AS (SELECT *, 1 AS priority FROM pm_d WHERE series < '3' UNION ALL SELECT period, series, -value, 2 FROM pm_d) SELECT CAST(period AS VARCHAR) AS period, series, round(value, 2) AS value FROM u QUALIFY row_number() OVER (PARTITION BY period, series ORDER BY priority, value) = 1")
def _(spark, d):
    p = pm(spark, d)
    both = p.filter("series < '3'").withColumn("priority", F.lit(1)).unionByName(p.withColumn("value", -v()).withColumn("priority", F.lit(2)))
    return shown(preprocess.first_by_priority(both).drop("priority"), 2)


@query("non_finite_to_null", f"WITH {LD} SELECT CAST(period AS VARCHAR) AS period, series, CASE WHEN month(period) % 3 = 0 THEN NULL ELSE value END AS value FROM lm_d")
def _(spark, d):
    m = F.month("period")
    bad = F.when(m % 3 == 0, F.when(m == 12, float("nan")).when(m == 3, float("inf")).otherwise(float("-inf"))).otherwise(v())
    return shown(panels.finite(lm(spark, d).withColumn("value", bad)))


# ---- joins in time


@query("lag_align", f"WITH {FC} SELECT CAST(f.period + INTERVAL 2 MONTH AS DATE)::VARCHAR AS period, f.series AS feature, round(f.value, 2) AS value, t.series, t.actual FROM pm_d f JOIN fc t ON t.period = CAST(f.period + INTERVAL 2 MONTH AS DATE)")
def _(spark, d):
    t = forecasts(spark, d).select("period", "series", "actual")
    return shown(align.lagged(pm(spark, d), t, 2))


@query(
    "asof_vintage",
    f"WITH {PD}, v AS (SELECT period AS since, series, value AS known FROM pm_d WHERE value IS NOT NULL), e AS (SELECT o_orderkey, o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, e.series, CAST(d AS VARCHAR) AS d, known FROM e ASOF LEFT JOIN v ON v.series = e.series AND v.since <= e.d",
)
def _(spark, d):
    v = pm(spark, d).filter("value is not null").select(F.col("period").alias("since"), "series", F.col("value").alias("known"))
    e = panels.read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"))
    return shown(align.as_of(e, v, ("series",), "d", "since"))


@query("interval_label", f"WITH {PD}, r(a, b) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in align.RECESSIONS) + ") SELECT CAST(period AS VARCHAR) AS period, series, CASE WHEN a IS NULL THEN 'expansion' ELSE 'recession' END AS regime FROM pm_d LEFT JOIN r ON period BETWEEN a AND b")
def _(spark, d):
    return shown(align.label(pm(spark, d), align.intervals(spark)).select("period", "series", "regime"))


@query(
    "targets",
    f"""WITH {PW}, y AS (SELECT period, 2 + day(period) / 10.0 AS y FROM pw WHERE day(period) > 3), x AS (SELECT p.period, value, ln(lead(value, 12) OVER o / value) AS nominal, ln(value / lag(value) OVER o) AS r FROM pw p WINDOW o AS (ORDER BY period)),
v AS (SELECT *, CASE WHEN count(r) OVER k >= 6 THEN stddev_samp(r) OVER k * sqrt(12) END AS vn FROM x WINDOW k AS (ORDER BY period ROWS 5 PRECEDING)), z AS (SELECT *, lead(vn, 12) OVER (ORDER BY period) AS vol FROM v),
dd AS (SELECT period, value + 5 AS value FROM pw WHERE day(period) < 25), e AS (SELECT period, ln(lead(value, 12) OVER (ORDER BY period) / value) AS infl FROM dd)
SELECT CAST(z.period AS VARCHAR) AS period, round(nominal, 6) AS nominal, round(vol, 6) AS vol, round(nominal - ln(1 + y / 100) * 12 / 12, 6) AS excess, round(coalesce(nominal - infl, nominal), 6) AS "real" FROM z LEFT JOIN y USING (period) LEFT JOIN e USING (period)""",
)
def _(spark, d):
    p = pw(spark, d)
    y = p.filter("day(period) > 3").withColumn("value", 2 + F.dayofmonth("period") / 10.0)
    return shown(align.targets(p, y, p.filter("day(period) < 25").withColumn("value", v() + 5)).select("period", "nominal", "vol", "excess", "real"))


FOLDS = f"""{LD}, b AS (SELECT min(period) AS lo, max(period) AS hi FROM lm_d), k AS (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS fold_id),
folds AS (SELECT fold_id, lo AS train_start, CAST(lo + to_months(36 + 6 * fold_id) - INTERVAL 1 DAY AS DATE) AS train_end, CAST(lo + to_months(38 + 6 * fold_id) AS DATE) AS val_start, CAST(lo + to_months(50 + 6 * fold_id) - INTERVAL 1 DAY AS DATE) AS val_end FROM b, k WHERE lo + to_months(50 + 6 * fold_id) <= hi)"""


def folds36(spark, d):
    return align.folds(panels.lineitem_month(spark, d), train=36, validate=12, step=6, gap=2)


@query("cv_folds", f"WITH {FOLDS} SELECT fold_id, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(val_start AS VARCHAR) AS val_start, CAST(val_end AS VARCHAR) AS val_end FROM folds")
def _(spark, d):
    return shown(folds36(spark, d))


@query("fold_rows", f"WITH {FOLDS} SELECT CAST(period AS VARCHAR) AS period, series, value, fold_id, CASE WHEN period <= train_end THEN 'train' ELSE 'validate' END AS part FROM lm_d JOIN folds ON period BETWEEN train_start AND train_end OR period BETWEEN val_start AND val_end")
def _(spark, d):
    return shown(align.fold_rows(lm(spark, d), folds36(spark, d)))


@query("holdout_split", f"WITH {LD}, p AS (SELECT DISTINCT period FROM lm_d), s AS (SELECT min(period) AS start FROM (SELECT period FROM p ORDER BY period DESC LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM p))) SELECT CAST(period AS VARCHAR) AS period, series, CASE WHEN period >= start THEN 'holdout' ELSE 'train' END AS part FROM lm_d, s")
def _(spark, d):
    panel = lm(spark, d)
    start = align.holdout_start(panel, 0.2, 12)
    return shown(panel.select("period", "series", F.when(F.col("period") >= F.lit(start), "holdout").otherwise("train").alias("part")))


@query("month_end_last", "WITH r AS (SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS series, round(max(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2) SELECT CAST(last_day(d) AS VARCHAR) AS period, series, arg_max(value, d) AS value FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = panels.read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("period"), F.col("l_returnflag").alias("series")).agg(F.round(F.max("l_extendedprice"), 2).alias("value"))
    return shown(transforms.month_end_last(rows))


@query("index_from_yields", f"WITH {PW}, y AS (SELECT period, 3 + (value - 1500) / 1000 AS value FROM pw), s AS (SELECT *, coalesce(lag(value / 100) OVER o / 12 - 7.5 * (value / 100 - lag(value / 100) OVER o), 0) AS s FROM y WINDOW o AS (ORDER BY period)) SELECT CAST(period AS VARCHAR) AS period, round(100 * exp(sum(ln(1 + s)) OVER (ORDER BY period)), 4) AS value FROM s")
def _(spark, d):
    return shown(transforms.index_from_yields(pw(spark, d).withColumn("value", 3 + (v() - 1500) / 1000)).select("period", "value"), 4)


@query(
    "splice",
    f"""WITH {PD}, m AS (SELECT CAST(last_day(period) AS DATE) AS period, series, value FROM pm_d WHERE period >= DATE '1998-01-01' AND value IS NOT NULL), h AS (SELECT period, series, value / 7 AS value FROM pm_d WHERE value IS NOT NULL),
st AS (SELECT series, date_trunc('month', min(period)) AS s, arg_min(value, period) AS f FROM m GROUP BY series), sc AS (SELECT h.series, st.f / h.value AS k, s FROM h JOIN st ON st.series = h.series AND h.period = st.s)
SELECT CAST(period AS VARCHAR) AS period, series, round(value, 2) AS value FROM m UNION ALL SELECT CAST(h.period AS VARCHAR), h.series, round(h.value * k, 2) FROM h JOIN sc ON sc.series = h.series AND h.period < s""",
)
def _(spark, d):
    p = pm(spark, d)
    return shown(transforms.splice(p.withColumn("value", v() / 7), p.filter("period >= date '1998-01-01'").withColumn("period", F.last_day("period"))), 2)


# ---- evaluation


@query(
    "forecast_metrics",
    f"WITH {FC} SELECT series, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(avg(CAST(sign(actual) = sign(predicted) AS DOUBLE)), 6) AS hit_rate, round(avg(abs(actual - predicted)) FILTER (sign(actual) = sign(predicted)), 6) AS directional_mae, round(1 - avg((actual - predicted) ** 2) / nullif(var_pop(actual), 0), 6) AS r2 FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series",
)
def _(spark, d):
    return shown(evaluation.metrics(forecasts(spark, d), "series"))


RANKS = f"""{FC}, k AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY actual) + (count(*) OVER (PARTITION BY series, actual) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series ORDER BY predicted) + (count(*) OVER (PARTITION BY series, predicted) - 1) / 2.0 AS p,
  row_number() OVER ({W_SQL}) AS rn, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL),
z AS (SELECT series, rn, n, (a - avg(a) OVER s) / stddev_pop(a) OVER s * ((p - avg(p) OVER s) / stddev_pop(p) OVER s) AS z FROM k WINDOW s AS (PARTITION BY series)), c AS (SELECT *, z - avg(z) OVER (PARTITION BY series) AS c FROM z)"""


@query("ic_by_series", f"WITH {RANKS} SELECT series, count(*) AS n, round(avg(z), 6) AS ic FROM z GROUP BY series")
def _(spark, d):
    return shown(evaluation.information_coefficient(forecasts(spark, d), "series"))


def _errors_sql() -> str:
    kernels = {
        "bartlett": "1 - j / 12.0", "equal": "1.0", "parzen": "CASE WHEN j / 12.0 <= 0.5 THEN 1 - 6 * (j / 12.0) ** 2 + 6 * (j / 12.0) ** 3 ELSE 2 * (1 - j / 12.0) ** 3 END",
        "quadratic": "CASE WHEN j = 0 THEN 1 ELSE 3 / (1.2 * pi() * j / 12.0) ** 2 * (sin(1.2 * pi() * j / 12.0) / (1.2 * pi() * j / 12.0) - cos(1.2 * pi() * j / 12.0)) END",
    }
    sums = ", ".join(f"round(sqrt(greatest(0, sum(CASE WHEN j = 0 THEN g ELSE 2 * ({k}) * g END)) / n), 6) AS {name}" for name, k in kernels.items())
    return f"WITH {RANKS}, j AS (SELECT unnest(range(0, 12)) AS j), g AS (SELECT x.series, x.n, j, avg(x.c * y.c) AS g FROM j, c x JOIN c y ON y.series = x.series AND y.rn = x.rn - j GROUP BY 1, 2, 3) SELECT series, n, {sums} FROM g GROUP BY series, n"


@query("rank_errors", _errors_sql())
def _(spark, d):
    return shown(inference.rank_error_table(forecasts(spark, d), 12, ("bartlett", "equal", "parzen", "quadratic"), "series"))


@query(
    "effective_sizes",
    f"""WITH {FC}, e AS (SELECT series, actual - predicted AS e, row_number() OVER ({W_SQL}) AS rn, count(*) OVER (PARTITION BY series) AS n FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL), c AS (SELECT *, e - avg(e) OVER (PARTITION BY series) AS c FROM e),
j AS (SELECT unnest(range(0, 37)) AS j), g AS (SELECT x.series, x.n, j, sum(x.c * y.c) / x.n AS g FROM j, c x JOIN c y ON y.series = x.series AND y.rn = x.rn - j GROUP BY 1, 2, 3), r AS (SELECT g.series, g.n, j, g.g / z.g AS r FROM g JOIN (SELECT series, g FROM g WHERE j = 0) z USING (series)),
q AS (SELECT series, n, greatest(-0.99, least(0.99, r)) AS rho FROM r WHERE j = 1), b AS (SELECT series, n, CASE WHEN abs(rho) < 0.01 THEN 1 ELSE greatest(1, ceil(1.1447 * (4 * rho ** 2 / ((1 - rho) ** 2 * (1 + rho) ** 2) * n) ** (1 / 3.0))) END AS bw FROM q),
s AS (SELECT *, abs(r) > 2 / sqrt(n) AS big, coalesce(abs(lead(r) OVER (PARTITION BY series ORDER BY j)) > 2 / sqrt(n), FALSE) AS nxt FROM r WHERE j > 0), t AS (SELECT series, coalesce(min(j) FILTER (NOT big AND NOT nxt), 37) AS stop FROM s GROUP BY series),
l AS (SELECT s.series, coalesce(max(j) FILTER (big AND j < stop) + 1, 1) AS len FROM s JOIN t USING (series) GROUP BY s.series)
SELECT r.series, CAST(r.n AS DOUBLE) AS n, round(greatest(1, r.n / 12), 4) AS simple, round(r.n / greatest(1, 1 + 2 * coalesce(sum((1 - j / (bw + 1)) * r) FILTER (j BETWEEN 1 AND least(bw, 36)), 0)), 4) AS newey_west,
  round(r.n / greatest(1, 1 + 2 * coalesce(sum((1 - j / 12.0) * r) FILTER (j BETWEEN 1 AND 11), 0)), 4) AS hansen_hodrick, round(r.n / any_value(len), 4) AS autocorr FROM r JOIN b USING (series) JOIN l USING (series) GROUP BY r.series, r.n""",
)
def _(spark, d):
    return shown(evaluation.effective_sizes(forecasts(spark, d), 12, "series"), 4)


TESTS = "t AS (SELECT p_brand || p_size AS test_id, count(*) AS n, round(least(1, (avg(p_retailprice) % 100) / 100 * CASE WHEN min(p_partkey) % 3 = 0 THEN 0.002 ELSE 1 END), 9) AS p_value FROM part GROUP BY p_brand, p_size)"


@query(
    "multiple_testing",
    f"""WITH {TESTS}, k AS (SELECT test_id, p_value, row_number() OVER (ORDER BY p_value, test_id) AS k, count(*) OVER () AS m FROM t),
q AS (SELECT *, p_value >= 0.05 / (m - k + 1) AS fail, CASE WHEN p_value <= k / m * 0.10 THEN 1 ELSE 0 END AS ok FROM k)
SELECT test_id, p_value, p_value < 0.05 / m AS bonferroni, NOT bool_or(fail) OVER u AS holm, max(ok) OVER a = 1 AS bh, round(least(1, min(p_value * m / k) OVER a), 6) AS q_value, least(1, min(p_value * m / k) OVER a) < 0.10 AS sig_adjusted
FROM q WINDOW u AS (ORDER BY p_value, test_id ROWS UNBOUNDED PRECEDING), a AS (ORDER BY p_value, test_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(spark, d):
    p = F.avg("p_retailprice") % 100 / 100 * F.when(F.min("p_partkey") % 3 == 0, 0.002).otherwise(1.0)
    tests = panels.read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.least(F.lit(1.0), p), 9).alias("p_value")).select(F.concat("p_brand", F.col("p_size").cast("string")).alias("test_id"), "p_value")
    out = evaluation.corrections(tests)
    return out.withColumn("q_value", F.round("q_value", 6))


def _rating_sql() -> str:
    rows = ", ".join(f"('{n}', {', '.join(map(str, v))})" for n, v in evaluation.RATINGS.items())
    return f"WITH l(c, e, g, a, m, s) AS (VALUES {rows}), i AS (SELECT p_partkey, (p_partkey % 250) / 1000 AS ic FROM part) SELECT p_partkey, c AS asset_class, ic, CASE WHEN ic >= e THEN 'excellent' WHEN ic >= g THEN 'good' WHEN ic >= a THEN 'acceptable' WHEN ic >= m THEN 'marginal' ELSE 'poor' END AS rating, ic > s AS suspicious, round(greatest(0, ic * sqrt(24) - 0.004 * sqrt(12)), 6) AS sharpe FROM i, l"


@query("benchmark_rating", _rating_sql())
def _(spark, d):
    rows = panels.read(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 250) / 1000).alias("ic"), F.explode(F.array(*[F.lit(n) for n in evaluation.RATINGS])).alias("asset_class"))
    ic, c = F.col("ic"), F.col("asset_class")
    return rows.select("p_partkey", "asset_class", "ic", evaluation.rating(ic, c).alias("rating"), evaluation.suspicious(ic, c).alias("suspicious"), F.round(evaluation.implied_sharpe(ic), 6).alias("sharpe"))


@query(
    "economic_significance",
    f"""WITH {FC}, f AS (SELECT * FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL), p AS (SELECT f.*, CAST(sign(predicted - quantile_cont(predicted, 0.5) OVER (PARTITION BY series)) AS DOUBLE) AS pos FROM f),
r AS (SELECT *, lag(pos) OVER o * actual AS ret, abs(pos - lag(pos) OVER o) AS turn FROM p WINDOW o AS ({W_SQL})), s AS (SELECT series, avg(ret) * 12 AS mean_return, stddev_samp(ret) * sqrt(12) AS volatility, avg(turn) AS turnover FROM r GROUP BY series)
SELECT series, round(mean_return * 0.1 / volatility, 6) AS mean_return, round(volatility, 6) AS volatility, round(turnover, 6) AS turnover, round(turnover * 0.001 * 12, 6) AS cost,
  round(mean_return * 0.1 / volatility - turnover * 0.012, 6) AS net_return, round((mean_return * 0.1 / volatility - turnover * 0.012) / 0.1, 6) AS sharpe FROM s""",
)
def _(spark, d):
    return shown(evaluation.economic(forecasts(spark, d), 10.0, "series"))


@query(
    "spearman_matrix",
    f"""WITH {ED}, x AS (SELECT a.series AS a, b.series AS b, a.value AS va, b.value AS vb FROM ed_d a JOIN ed_d b ON a.period = b.period AND a.series <= b.series WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM x)
SELECT a, b, count(*) AS n, round(corr(ra, rb), 6) AS rho, round(greatest(0, 1 - abs(corr(ra, rb))), 6) AS distance FROM r GROUP BY a, b""",
)
def _(spark, d):
    return shown(evaluation.spearman_matrix(ed(spark, d)))


MODELS = f"{FC}, ml AS (SELECT 'naive' AS model, period, series, actual, predicted FROM fc UNION ALL SELECT 'reverse', period, series, actual, -predicted / 2 FROM fc WHERE month(period) > 2 UNION ALL SELECT 'drift', period, series, actual, 0.01 FROM fc)"


def models(spark, d):
    f = forecasts(spark, d)
    f = f.select(F.lit("naive").alias("model"), *f.columns)
    reverse = f.filter("month(period) > 2").withColumn("model", F.lit("reverse")).withColumn("predicted", -F.col("predicted") / 2)
    return f.unionByName(reverse).unionByName(f.withColumn("model", F.lit("drift")).withColumn("predicted", F.lit(0.01)))


@query("ensemble_average", f"WITH {MODELS} SELECT series, CAST(period AS VARCHAR) AS period, round(avg(predicted), 9) AS predicted, round(max(actual), 9) AS actual FROM ml WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series, period HAVING count(DISTINCT model) = 3")
def _(spark, d):
    return shown(evaluation.ensemble(models(spark, d), 3, "series"), 9)


@query("consensus_vote", f"WITH {MODELS}, v AS (SELECT series, period, avg(CAST(predicted > 0 AS DOUBLE)) AS b FROM ml WHERE predicted IS NOT NULL GROUP BY series, period) SELECT series, CAST(period AS VARCHAR) AS period, round(b, 6) AS bullish, CASE WHEN b > 0.6 THEN 'BULLISH' WHEN b < 0.4 THEN 'BEARISH' ELSE 'NEUTRAL' END AS vote FROM v")
def _(spark, d):
    return shown(evaluation.consensus(models(spark, d), "series"))


RESULTS = f"{MODELS}, res AS (SELECT series, model, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(CAST(sign(actual) = sign(predicted) AS DOUBLE)) AS hit FROM ml WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series, model)"


@query("top_models", f"WITH {RESULTS}, k AS (SELECT series, model, round(hit, 6) AS hit_rate, CAST(row_number() OVER (PARTITION BY series ORDER BY round(hit, 6) DESC, model) AS INTEGER) AS rank FROM res) SELECT * FROM k WHERE rank <= 2")
def _(spark, d):
    m = evaluation.metrics(models(spark, d), "series", "model").select("series", "model", F.round("hit_rate", 6).alias("hit_rate"))
    return evaluation.top_k(m, "hit_rate", 2, "series")


@query("results_pivot", f"WITH {RESULTS} SELECT series, round(max(rmse) FILTER (model = 'naive'), 6) AS naive, round(max(rmse) FILTER (model = 'reverse'), 6) AS reverse, round(max(rmse) FILTER (model = 'drift'), 6) AS drift FROM res GROUP BY series")
def _(spark, d):
    m = evaluation.metrics(models(spark, d), "series", "model")
    return shown(m.groupBy("series").pivot("model", ["naive", "reverse", "drift"]).agg(F.first("rmse")))


@query("results_upsert", f"WITH {RESULTS} SELECT series, model, round(rmse, 6) AS rmse, CAST(NULL AS VARCHAR) AS fresh FROM res WHERE series NOT IN ('1-URGENT', '5-LOW') UNION ALL SELECT series, model, round(rmse * 2, 6), 'yes' FROM res WHERE series IN ('1-URGENT', '5-LOW')")
def _(spark, d):
    old = evaluation.metrics(models(spark, d), "series", "model").select("series", "model", "rmse")
    new = old.filter("series in ('1-URGENT', '5-LOW')").withColumn("rmse", F.col("rmse") * 2).withColumn("fresh", F.lit("yes"))
    return shown(evaluation.upsert(old, new, "series"))


@query("percentile_signal", f"WITH {ED}, c AS (SELECT series, arg_max(value, period) AS cur FROM ed_d WHERE value IS NOT NULL GROUP BY series), p AS (SELECT e.series, cur, avg(CAST(value < cur AS DOUBLE)) * 100 AS p FROM ed_d e JOIN c USING (series) WHERE value IS NOT NULL GROUP BY 1, 2) SELECT series, round(cur, 6) AS current, round(p, 6) AS percentile, CASE WHEN p > 80 THEN 'Very High' WHEN p > 60 THEN 'High' WHEN p > 40 THEN 'Neutral' WHEN p > 20 THEN 'Low' ELSE 'Very Low' END AS signal FROM p")
def _(spark, d):
    return shown(evaluation.percentile_signal(ed(spark, d)))


@query(
    "regime_ic",
    f"""WITH {FC}, g AS (SELECT CASE WHEN period BETWEEN DATE '2001-03-01' AND DATE '2001-11-30' THEN 'recession' ELSE 'expansion' END AS regime, actual, predicted FROM fc WHERE actual IS NOT NULL AND predicted IS NOT NULL),
k AS (SELECT regime, rank() OVER (PARTITION BY regime ORDER BY actual) + (count(*) OVER (PARTITION BY regime, actual) - 1) / 2.0 AS a, rank() OVER (PARTITION BY regime ORDER BY predicted) + (count(*) OVER (PARTITION BY regime, predicted) - 1) / 2.0 AS p FROM g)
SELECT regime, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(a, p), 6) END AS ic FROM k GROUP BY regime""",
)
def _(spark, d):
    return shown(inference.regime_ics(forecasts(spark, d), align.intervals(spark)))


@query("sequences", f"WITH {PD}, s AS (SELECT period, series, count(value) OVER k AS c, count(*) OVER k AS n, row_number() OVER ({W_SQL}) AS rn FROM pm_d WINDOW k AS ({W_SQL} ROWS 11 PRECEDING)) SELECT series, count(*) FILTER (n = 12 AND (rn - 12) % 6 = 0) AS possible, count(*) FILTER (n = 12 AND c = 12 AND (rn - 12) % 6 = 0) AS usable FROM s GROUP BY series")
def _(spark, d):
    frame = w.rolling(12)
    rows = pm(spark, d).select("series", F.count(v()).over(frame).alias("c"), F.count(F.lit(1)).over(frame).alias("n"), F.row_number().over(w.by_series()).alias("rn"))
    at = (F.col("n") == 12) & ((F.col("rn") - 12) % 6 == 0)
    return rows.groupBy("series").agg(F.count(F.when(at, 1)).alias("possible"), F.count(F.when(at & (F.col("c") == 12), 1)).alias("usable"))


# ---- beyond the reference: event-time windows


@query("events_tumbling", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = panels.read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


@query("events_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS k, count(*) AS n FROM k GROUP BY user_id, k")
def _(spark, d):
    e = panels.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("s.start"))
    return e.select("user_id", k.cast("long").alias("k"), "n")


# ---- tests and models that SQL cannot express


@query("stationarity")
def _(spark, d):
    return shown(stats.stationarity(panels.lineitem_month(spark, d).unionByName(pw(spark, d))))


PAIR_ROWS = [("okun_law", "AF", "RF"), ("consumption_income", "NO", "AF"), ("no_rf", "NO", "RF")]


@query("cointegration")
def _(spark, d):
    out = stats.cointegration(panels.lineitem_month(spark, d), spark.createDataFrame(PAIR_ROWS, "name string, a string, b string"))
    return shown(stats.weighted(out))


@query("error_correction")
def _(spark, d):
    """a - beta * b by the pair's vector, its expanding score and changes."""
    panel, pairs = lm(spark, d), spark.createDataFrame(PAIR_ROWS, "name string, a string, b string")
    found = stats.cointegration(panels.lineitem_month(spark, d), pairs).select("name", "beta").join(pairs, "name")
    x, y = panel.selectExpr("period", "series as a", "value as va"), panel.selectExpr("period", "series as b", "value as vb")
    ect = x.join(F.broadcast(found), "a").join(y, ["period", "b"]).select("period", F.col("name").alias("series"), (F.col("va") - F.col("beta") * F.col("vb")).alias("value"))
    changes = [(v() - transforms.lag(v(), k)).alias(f"chg_{k}") for k in (1, 3, 6)]
    return shown(ect.select("period", "series", "value", w.zscore(v(), w.expanding()).alias("zscore"), *changes))


@query("feature_clusters")
def _(spark, d):
    long = transforms.momentum(lm(spark, d)).withColumnRenamed("feature", "series")
    return stats.clusters(evaluation.spearman_matrix(long), 10)


def design(spark, d) -> tuple[DataFrame, list[str]]:
    """Momentum of the weekly price as features, the return of the next four weeks as target."""
    p = pw(spark, d)
    features = transforms.momentum(p, (3, 6))
    names = [f"price_{k}_{n}M" for n in (3, 6) for k in ("chg", "zscore")]
    target = p.select("period", F.log(F.lead("value", 4).over(w.by_series()) / v()).alias("y"))
    return models_.wide(features, names).join(target, "period"), names


@query("linear_models")
def _(spark, d):
    data, names = design(spark, d)
    rows = models_.vectors(data.dropna(subset=["y"]), names)
    out = []
    for name in ("ridge", "lasso", "elastic_net"):
        fitted = models_.FACTORIES[name](rows)
        out += [(name, f, float(c)) for f, c in zip(names, fitted.coefficients.toArray(), strict=True)] + [(name, "intercept", float(fitted.intercept))]
    return shown(spark.createDataFrame(out, "model string, feature string, coefficient double"), 5)


@query("tree_importances")
def _(spark, d):
    data, names = design(spark, d)
    rows = models_.vectors(data.dropna(subset=["y"]), names)
    out = [(m, f, x) for m, fitted in (("random_forest", models_.random_forest(rows, 20)), ("boosting", models_.boosting(rows, 10))) for f, x in models_.importances(fitted, names)]
    return shown(spark.createDataFrame(out, "model string, feature string, importance double"), 5)


@query("tournament")
def _(spark, d):
    data, names = design(spark, d)
    return shown(learners.leaderboard(learners.tournament(data, names, ("ridge", "lasso"), "standard", train=36, validate=12, step=12)), 5)


@query("placebo_test")
def _(spark, d):
    return shown(models_.placebo(forecasts(spark, d), 200, 7, "series"))


@query("block_bootstrap")
def _(spark, d):
    return shown(validation.block_bootstrap(forecasts(spark, d), 6, 200, 42, "series"))


@query("romano_wolf")
def _(spark, d):
    return shown(validation.romano_wolf(models(spark, d).withColumn("model", F.concat_ws("|", "series", "model")), 6, 200))


@query("nested_cv")
def _(spark, d):
    data, names = design(spark, d)
    return shown(learners.nested(data, names, ("ridge", "lasso"), 2, 48, 12, 1, train=24, validate=12, step=12), 5)


@query("pair_stability")
def _(spark, d):
    return shown(validation.rolling_stability(panels.lineitem_month(spark, d), spark.createDataFrame(PAIR_ROWS, "name string, a string, b string"), 36, 12))


CLUSTER_ROWS = [("1-URGENT", 1), ("2-HIGH", 1), ("3-MEDIUM", 2), ("4-NOT SPECIFIED", 2), ("5-LOW", 2)]


@query(
    "cluster_representatives",
    f"WITH {PD}, c(series, cluster) AS (VALUES " + ", ".join(map(str, CLUSTER_ROWS)) + "), s AS (SELECT cluster, series, var_samp(value) AS v FROM pm_d JOIN c USING (series) WHERE value IS NOT NULL GROUP BY 1, 2) SELECT cluster, 'variance' AS how, arg_max(series, v) AS series FROM s GROUP BY cluster UNION ALL SELECT cluster, 'first', min(series) FROM s GROUP BY cluster",
)
def _(spark, d):
    clusters = spark.createDataFrame(CLUSTER_ROWS, "feature string, cluster int")
    parts = [validation.representatives(pm(spark, d), clusters, how).select("cluster", F.lit(how).alias("how"), "series") for how in ("variance", "first")]
    return parts[0].unionByName(parts[1])


@query(
    "vintage_scores",
    f"""WITH {PD}, m AS (SELECT DISTINCT period AS vintage FROM pm_d WHERE month(period) % 6 = 0), x AS (SELECT vintage, p.* FROM m JOIN pm_d p ON p.period <= vintage),
s AS (SELECT *, last_value(value IGNORE NULLS) OVER o AS filled, CASE WHEN count(value) OVER o >= 2 THEN (value - avg(value) OVER o) / nullif(stddev_samp(value) OVER o, 0) END AS z FROM x WINDOW o AS (PARTITION BY vintage, series ORDER BY period))
SELECT CAST(vintage AS VARCHAR) AS vintage, series, CAST(period AS VARCHAR) AS period, round(filled, 2) AS filled, round(z, 6) AS zscore FROM s WHERE period = vintage""",
)
def _(spark, d):
    out = validation.known_at(validation.truncated(pm(spark, d)))
    return shown(out.withColumn("filled", F.round("filled", 2)))


@query("regime_vote", f"WITH {ED}, c AS (SELECT series, arg_max(value, period) AS cur FROM ed_d WHERE value IS NOT NULL GROUP BY series), p AS (SELECT e.series, avg(CAST(value < cur AS DOUBLE)) * 100 AS p FROM ed_d e JOIN c USING (series) WHERE value IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (p > 60) AS high, count(*) FILTER (p <= 40) AS low, least(99, greatest(1, 50 + 5 * (count(*) FILTER (p > 60) - count(*) FILTER (p <= 40)))) AS probability FROM p")
def _(spark, d):
    return validation.regime_vote(evaluation.percentile_signal(ed(spark, d)))


@query("base_features")
def _(spark, d):
    panel = lm(spark, d)
    codes = panel.select("series").distinct().withColumn("code", F.when(F.col("series") == "AF", 5).otherwise(2))
    return shown(validation.base_features(panel, codes, spark.createDataFrame(PAIRS, "name string, left string, right string, kind string")))


@query("alignment_report", f"WITH {FC} SELECT count(*) AS rows, CAST(min(t.period) AS VARCHAR) AS first, CAST(max(t.period) AS VARCHAR) AS last, CAST(0 AS BIGINT) AS look_ahead FROM pm_d f JOIN fc t ON t.period = CAST(f.period + INTERVAL 2 MONTH AS DATE)")
def _(spark, d):
    t = forecasts(spark, d).select("period", F.col("series").alias("target"), "actual")
    return shown(validation.alignment(pm(spark, d), t, 2))
