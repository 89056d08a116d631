"""Stationarity transforms, growth, ratios, spreads and momentum. Inputs are dense panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w

#: Stands for a negative value under the logarithm when on_negative is "clip".
TINY = 1e-10
MOMENTUM = (6, 12, 18)


# Fixed values: (left, right, name, kind) of the usual ratios and real rates, by theme.
RATIOS = {
    "liquidity": (("M2SL", "INDPRO", "M2_GDP_Ratio", "log"), ("M2SL", "RPI", "M2_Personal_Income", "log"), ("BOGMBASE", "INDPRO", "Reserves_GDP", "log"), ("TOTRESNS", "INDPRO", "TotalReserves_GDP", "log")),
    "leverage": (("BUSLOANS", "INDPRO", "BusinessLoans_GDP", "log"), ("CONSUMER", "RPI", "ConsumerDebt_DPI", "log"), ("TOTALSL", "RPI", "TotalConsumerCredit_DPI", "log")),
    "real_rates": (
        ("GS10", "CPIAUCSL_yoy", "Real_10Y_Yield", "diff"), ("GS5", "CPIAUCSL_yoy", "Real_5Y_Yield", "diff"), ("GS1", "CPIAUCSL_yoy", "Real_1Y_Yield", "diff"),
        ("FEDFUNDS", "CPIAUCSL_yoy", "Real_Fed_Funds", "diff"), ("TB3MS", "CPIAUCSL_yoy", "Real_3M_Rate", "diff"),
    ),
    "activity": (("INDPRO", "PAYEMS", "IP_Per_Employee", "log"), ("RPI", "PAYEMS", "Income_Per_Employee", "log"), ("DPCERA3M086SBEA", "PI", "Consumption_Income_Ratio", "log")),
    "spreads": (("BAA", "AAA", "BAA_AAA_Spread", "diff"), ("GS10", "GS1", "Yield_Curve_10Y_1Y", "diff"), ("GS10", "TB3MS", "Yield_Curve_10Y_3M", "diff"), ("GS5", "GS1", "Yield_Curve_5Y_1Y", "diff")),
}
# Spreads of rates, by kind.
SPREADS = {
    "credit": (("BAA", "AAA", "BAA_AAA_Spread"), ("BAA", "GS10", "BAA_10Y_Spread"), ("AAA", "GS10", "AAA_10Y_Spread")),
    "yield_curve": (("GS10", "GS2", "YC_10Y_2Y"), ("GS10", "GS1", "YC_10Y_1Y"), ("GS10", "TB3MS", "YC_10Y_3M"), ("GS5", "GS2", "YC_5Y_2Y"), ("GS2", "TB3MS", "YC_2Y_3M")),
    "ted_spread": (("TB3MS", "FEDFUNDS", "TED_Spread_Proxy"),),
}


def definitions(spark: SparkSession, themes: tuple[str, ...] | None = None, extra: tuple[tuple[str, str, str, str], ...] = ()) -> DataFrame:
    """(name, left, right, kind) of the chosen themes of ratios and spreads (all of them without a choice) and own ones; a name counts once."""
    rows = [(name, a, b, kind) for theme, group in RATIOS.items() if themes is None or theme in themes for a, b, name, kind in group]
    rows += [(name, a, b, "diff") for theme, group in SPREADS.items() if themes is None or theme in themes for a, b, name in group]
    rows += [(name, a, b, kind) for a, b, name, kind in extra]
    return spark.createDataFrame(list({r[0]: r for r in reversed(rows)}.values()), "name string, left string, right string, kind string")


def safe_log(v: Column, on_negative: str = "clip") -> Column:
    negative = F.lit(TINY) if on_negative == "clip" else F.lit(None).cast("double")
    return F.log(F.when(v > 0, v).when(v < 0, negative))


def lag(v: Column, k: int = 1) -> Column:
    return F.lag(v, k).over(w.by_series())


def transform(panel: DataFrame, codes: DataFrame, on_negative: str = "clip") -> DataFrame:
    """panel with column `out`, by code: 1 level, 2 difference, 3 second difference, 4 log, 5 log
    difference, 6 second log difference, 7 change in percent; a series without code has code 1."""
    v = F.col("value")
    rows = panel.join(codes, "series", "left").withColumn("code", F.coalesce("code", F.lit(1)))
    rows = rows.withColumn("ln", safe_log(v, on_negative)).withColumn("filled", F.last(v, ignorenulls=True).over(w.expanding("series", "code")))
    back = lambda c, k: F.lag(c, k).over(w.by_series("series", "code"))
    ln, filled = F.col("ln"), F.col("filled")
    out = (
        F.when(F.col("code") == 2, v - back(v, 1))
        .when(F.col("code") == 3, v - 2 * back(v, 1) + back(v, 2))
        .when(F.col("code") == 4, ln)
        .when(F.col("code") == 5, ln - back(ln, 1))
        .when(F.col("code") == 6, ln - 2 * back(ln, 1) + back(ln, 2))
        .when(F.col("code") == 7, filled / w.nonzero(back(filled, 1)) - 1)
        .otherwise(v)
    )
    return rows.withColumn("out", out).drop("ln", "filled")


def inverse(panel: DataFrame, code: int) -> DataFrame:
    """panel (value, out) with `back`: value rebuilt from out by running sums or products and the first value."""
    out, first = F.col("out"), F.first("value", ignorenulls=True).over(w.expanding())
    total = F.coalesce(F.sum(out).over(w.expanding()), F.lit(0.0))
    if code == 2:
        back = first + total
    elif code in (3, 6):
        # twice summed: the first step and the first value come from the original
        level = F.col("value") if code == 3 else safe_log(F.col("value"))
        rows = panel.withColumn("x_level", level).withColumn("x_at", F.row_number().over(w.by_series()))
        rows = rows.withColumn("x_first", F.first("x_level", ignorenulls=True).over(w.expanding())).withColumn("x_step", F.when(F.col("x_at") == 2, F.col("x_level") - F.col("x_first")))
        slope = F.coalesce(F.sum("out").over(w.expanding()), F.lit(0.0)) + F.first("x_step", ignorenulls=True).over(w.expanding())
        rows = rows.withColumn("x_slope", F.when(F.col("x_at") > 1, slope))
        total = F.col("x_first") + F.coalesce(F.sum("x_slope").over(w.expanding()), F.lit(0.0))
        return rows.withColumn("back", total if code == 3 else F.exp(total)).drop("x_level", "x_at", "x_first", "x_step", "x_slope")
    elif code == 4:
        back = F.exp(out)
    elif code == 5:
        back = first * F.exp(total)
    elif code == 7:
        back = first * F.product(1 + F.coalesce(out, F.lit(0.0))).over(w.expanding())
    else:
        back = out
    return panel.withColumn("back", back)


def growth(v: Column, k: int, per_year: int = 12, annualised: bool = True) -> Column:
    return F.log(w.nonzero(v) / w.nonzero(lag(v, k))) * (per_year / k if annualised else 1.0)


def log_acceleration(v: Column, k: int) -> Column:
    ln = safe_log(v)
    return ln - 2 * F.lag(ln, k).over(w.by_series()) + F.lag(ln, 2 * k).over(w.by_series())


def moving_average_momentum(v: Column, short: int = 3, long: int = 12) -> Column:
    return w.mean(v, w.rolling(short), short) - w.mean(v, w.rolling(long), long)


def rate_of_change(v: Column, k: int) -> Column:
    return (v - lag(v, k)) / w.nonzero(F.abs(lag(v, k)))


def momentum(panel: DataFrame, windows: tuple[int, ...] = MOMENTUM) -> DataFrame:
    """Long: (period, feature, value) with chg, accel and zscore for each window; one pass over one window order."""
    v = F.col("value")
    wide = panel
    for n in windows:
        wide = wide.withColumn(f"chg_{n}M", v - lag(v, n)).withColumn(f"accel_{n}M", v - 2 * lag(v, n) + lag(v, 2 * n))
        wide = wide.withColumn(f"zscore_{n}M", w.zscore(v, w.rolling(n), min(n, 12)))
    names = [f"{kind}_{n}M" for n in windows for kind in ("chg", "accel", "zscore")]
    long = wide.unpivot(["period", "series"], names, "kind", "value")
    return long.select("period", F.concat_ws("_", "series", "kind").alias("feature"), "value")


def pairs(panel: DataFrame, definitions: DataFrame) -> DataFrame:
    """definitions (name, left, right, kind): ln(left / right) for kind "log", left - right else.
    Series that are absent give no rows."""
    a = panel.select("period", F.col("series").alias("left"), F.col("value").alias("a"))
    b = panel.select("period", F.col("series").alias("right"), F.col("value").alias("b"))
    both = a.join(F.broadcast(definitions), "left").join(b, ["period", "right"])
    ratio = F.col("a") / w.nonzero(F.col("b"))
    value = F.when(F.col("kind") == "log", F.when(ratio > 0, F.log(ratio))).otherwise(F.col("a") - F.col("b"))
    return both.select("period", F.col("name").alias("series"), value.alias("value"))


def levels(panel: DataFrame, codes: DataFrame) -> DataFrame:
    """The series whose code says that their levels are stationary (1), as <series>_level."""
    chosen = codes.filter("code = 1").select("series")
    return panel.join(chosen, "series", "left_semi").select("period", F.concat("series", F.lit("_level")).alias("series"), "value")


def without_levels(features: DataFrame) -> DataFrame:
    """features (period, feature, value) without raw levels."""
    return features.filter(~F.col("feature").endswith("_level"))


def changes(panel: DataFrame, windows: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    wide = panel.select("period", "series", *[(F.col("value") - lag(F.col("value"), n)).alias(f"chg_{n}M") for n in windows])
    long = wide.unpivot(["period", "series"], [f"chg_{n}M" for n in windows], "kind", "value")
    return long.select("period", F.concat_ws("_", "series", "kind").alias("feature"), "value")


def year_on_year(v: Column, per_year: int = 12) -> Column:
    return (v / w.nonzero(lag(v, per_year)) - 1) * 100


def returns(v: Column, k: int = 1) -> Column:
    ratio = v / w.nonzero(lag(v, k))
    return F.when(ratio > 0, F.log(ratio))


def month_end_last(prices: DataFrame) -> DataFrame:
    """The last value that is not null of each calendar month, dated at the month's end."""
    rows = prices.filter("value is not null").groupBy(F.last_day("period").alias("period"), "series")
    return rows.agg(F.max_by("value", "period").alias("value"))


def index_from_yields(yields: DataFrame, duration: float = 7.5) -> DataFrame:
    """Carry less duration times the change of the yield (in percent), compounded from 100."""
    y = F.col("value") / 100
    before = lag(y)
    step = F.coalesce(before / 12 - duration * (y - before), F.lit(0.0))
    return yields.withColumn("step", step).withColumn("value", 100 * F.product(1 + F.col("step")).over(w.expanding())).drop("step")


def splice(history: DataFrame, modern: DataFrame) -> DataFrame:
    """Modern rows, and before them history scaled to the modern series' first month."""
    m = modern.filter("value is not null").withColumn("month", F.trunc("period", "month"))
    start = m.groupBy("series").agg(F.min("month").alias("start"), F.min_by("value", "period").alias("first"))
    h = history.filter("value is not null").withColumn("month", F.trunc("period", "month")).join(start, "series")
    scale = h.filter("month = start").groupBy("series").agg((F.first("first") / w.nonzero(F.max_by("value", "period"))).alias("scale"))
    before = h.filter("month < start").join(scale, "series").select("period", "series", (F.col("value") * F.col("scale")).alias("value"))
    return before.unionByName(m.select("period", "series", "value"))
