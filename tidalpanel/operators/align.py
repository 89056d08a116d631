"""Joins in time: publication lags, as-of picks, interval labels, targets, folds and holdouts."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalpanel.functions import windows as w
from tidalpanel.operators.transforms import returns

# First and last days of the default recession months.
RECESSIONS = (
    ("1980-01-01", "1980-07-31"), ("1981-07-01", "1982-11-30"), ("1990-07-01", "1991-03-31"),
    ("2001-03-01", "2001-11-30"), ("2007-12-01", "2009-06-30"), ("2020-02-01", "2020-04-30"),
)


def lagged(features: DataFrame, targets: DataFrame, months: int) -> DataFrame:
    """Features become known `months` later; they meet the targets of that period."""
    known = features.select(F.add_months("period", months).alias("period"), F.col("series").alias("feature"), "value")
    return known.join(targets, "period")


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], at: str, since: str, days: int = 31) -> DataFrame:
    """left with the columns of the latest right row whose `since` is not after `at` (dates, or numbers): one
    sort-based pass over both sides by key and span of `days` (or units), no range join.

    Each span gets the last right row before it, found on one row a key and span, so a key that
    holds very many rows is cut into spans."""
    names = [c for c in right.columns if c not in (*keys, since)]
    a = left.select("*", F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in right.schema if f.name in names) + ">").alias("x_right"), F.col(at).alias("x_at"), F.lit(1).alias("x_side"))
    b = right.select(*keys, F.struct(*names).alias("x_right"), F.col(since).alias("x_at"), F.lit(0).alias("x_side"))
    numeric = dict(left.dtypes)[at] not in ("date", "timestamp", "timestamp_ntz", "string")
    place = F.col("x_at") if numeric else F.unix_date(F.col("x_at").cast("date"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("x_span", F.floor(place / days))
    spans = both.groupBy(*keys, "x_span").agg(F.max(F.when(F.col("x_side") == 0, F.struct("x_at", "x_right")))["x_right"].alias("x_last"))
    before = Window.partitionBy(*keys).orderBy("x_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "x_span", F.last("x_last", ignorenulls=True).over(before).alias("x_right"), F.lit(-1).alias("x_side")).filter("x_right is not null")
    frame = Window.partitionBy(*keys, "x_span").orderBy(F.col("x_at").asc_nulls_first(), "x_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(carried, allowMissingColumns=True).withColumn("x_right", F.last("x_right", ignorenulls=True).over(frame)).filter("x_side = 1")
    return found.select(*left.columns, "x_right.*")


def intervals(spark: SparkSession, rows=RECESSIONS) -> DataFrame:
    return spark.createDataFrame([(date.fromisoformat(a), date.fromisoformat(b)) for a, b in rows], "start date, stop date")


def label(panel: DataFrame, spans: DataFrame, inside: str = "recession", outside: str = "expansion") -> DataFrame:
    """panel with regime; spans are a few rows and do not overlap."""
    joined = panel.join(F.broadcast(spans), F.col("period").between(F.col("start"), F.col("stop")), "left")
    return joined.withColumn("regime", F.when(F.col("start").isNotNull(), inside).otherwise(outside)).drop("start", "stop")


def targets(prices: DataFrame, yields: DataFrame | None = None, deflator: DataFrame | None = None, h: int = 12, per_year: int = 12) -> DataFrame:
    """nominal, excess, real and vol targets over the next h periods, and the forward volatility of six returns."""
    p = F.col("value")
    ahead = lambda c, k: F.lead(c, k).over(w.by_series())
    rows = prices.withColumn("nominal", F.when((p > 0) & (ahead(p, h) > 0), F.log(ahead(p, h) / p))).withColumn("ret", returns(p))
    vol = w.sd(F.col("ret"), w.rolling(6), 6) * F.sqrt(F.lit(float(per_year)))
    rows = rows.withColumn("vol_now", vol)
    rows = rows.withColumn("vol", ahead(F.col("vol_now"), h)).drop("vol_now")
    if yields is not None:
        rows = rows.join(yields.select("period", F.col("value").alias("y")), "period", "left").withColumn("excess", F.col("nominal") - F.log(1 + F.col("y") / 100) * h / per_year).drop("y")
    if deflator is not None:
        d = deflator.select("period", "value", F.lead("value", h).over(Window.orderBy("period")).alias("later"))
        rows = rows.join(d.select("period", F.log(w.nonzero(F.col("later")) / w.nonzero(F.col("value"))).alias("inflation")), "period", "left")
        rows = rows.withColumn("real", F.coalesce(F.col("nominal") - F.col("inflation"), F.col("nominal"))).drop("inflation")
    return rows.drop("ret", "value")


def vintage_dates(spark: SparkSession, first: str, until: str, months: int = 6) -> DataFrame:
    """(vintage): the last days of every `months`-th month of the year (June and December, or the quarters), from first to until."""
    span = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(until).cast("date"), F.expr("interval 1 month")))
    days = spark.range(1).select(span.alias("x_day")).select(F.last_day("x_day").alias("vintage"))
    return days.filter((F.month("vintage") % months == 0) & (F.col("vintage") <= F.lit(until).cast("date")))


def plus_months(d: date, n: int) -> date:
    """As add_months: the day is cut to the month's length."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def fold_bounds(first: date, last: date, train: int = 120, validate: int = 12, step: int = 6, gap: int = 0) -> list[tuple]:
    """(fold_id, train_start, train_end, val_start, val_end): training grows, validation moves on by step."""
    out, start = [], plus_months(first, train + gap)
    while plus_months(start, validate) <= last:
        out.append((len(out), first, plus_months(start, -gap) - timedelta(days=1), start, plus_months(start, validate) - timedelta(days=1)))
        start = plus_months(start, step)
    return out


def folds(panel: DataFrame, **options) -> DataFrame:
    first, last = panel.agg(F.min("period"), F.max("period")).first()
    rows = fold_bounds(first, last, **options) if first else []
    return panel.sparkSession.createDataFrame(rows, "fold_id int, train_start date, train_end date, val_start date, val_end date")


def fold_rows(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """panel rows with fold_id and part (train, validate); the folds are few and broadcast."""
    train = F.col("period").between(F.col("train_start"), F.col("train_end"))
    validate = F.col("period").between(F.col("val_start"), F.col("val_end"))
    return panel.join(F.broadcast(bounds), train | validate).select(*panel.columns, "fold_id", F.when(train, "train").otherwise("validate").alias("part"))


def holdout_start(panel: DataFrame, share: float = 0.15, least: int = 48) -> date:
    """First period held out: the last share of the distinct periods."""
    periods = panel.select("period").distinct()
    n = periods.count()
    held = int(n * share)
    if held < least:
        raise ValueError(f"{held} periods held out; at least {least} are needed")
    return periods.orderBy(F.desc("period")).limit(held).agg(F.min("period")).first()[0]


def outer_folds(first: date, last: date, n: int = 5, least: int = 120, test: int = 24) -> list[tuple[date, date, date]]:
    """(train_end, test_start, test_end) spread evenly over what is left after the least training span; one fold if nothing is left."""
    usable = (last - first).days / 30.44 - least - test
    step = usable / (n - 1) if n > 1 and usable > 0 else 0
    out = []
    for k in range(n if usable > 0 else 1):
        end = plus_months(first, least + int(k * step))
        start = end + timedelta(days=1)
        out.append((end, start, min(plus_months(start, test), last)))
    return out
