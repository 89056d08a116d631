"""Panels (period, series, value) from the driver's tables, and their densification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("period"), F.col("o_orderpriority").alias("series"), "o_totalprice")
    return rows.groupBy("period", "series").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def lineitem_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("period"), F.concat("l_returnflag", "l_linestatus").alias("series"), "l_extendedprice")
    return rows.groupBy("period", "series").agg(F.round(F.avg("l_extendedprice"), 4).alias("value"))


def price_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average unit price a week, one series."""
    rows = read(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("period"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return rows.groupBy("period").agg(F.round(F.avg("p"), 4).alias("value")).select("period", F.lit("price").alias("series"), "value")


def events_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.to_date("ts").alias("period"), F.col("event_type").alias("series"), "value")
    return rows.groupBy("period", "series").agg(F.round(F.avg("value"), 4).alias("value"))


def densify(panel: DataFrame) -> DataFrame:
    """Every observed period with every series; missing cells are null. Positional lags need it.

    Both sides are distinct keys of an aggregated panel (periods, series), not rows of the source."""
    periods, series = panel.select("period").distinct(), panel.select("series").distinct()
    return periods.join(series, F.lit(True)).join(panel, ["period", "series"], "left").select("period", "series", "value")


def finite(panel: DataFrame, column: str = "value") -> DataFrame:
    """NaN and infinities become null at the boundary."""
    bad = F.isnan(column) | (F.abs(F.col(column)) == float("inf"))
    return panel.withColumn(column, F.when(~bad, F.col(column)))


#: The same panels for DuckDB, as common table expressions.
SQL = {
    "pm": "pm AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS series, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)",
    "lm": "lm AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag || l_linestatus AS series, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2)",
    "pw": "pw AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS period, 'price' AS series, round(avg(l_extendedprice / l_quantity), 4) AS value FROM lineitem GROUP BY 1)",
    "ed": "ed AS (SELECT CAST(ts AS DATE) AS period, event_type AS series, round(avg(value), 4) AS value FROM events GROUP BY 1, 2)",
}


def dense_sql(name: str) -> str:
    """CTEs `name` and `name`_d, the dense one."""
    return f"{SQL[name]}, {name}_d AS (SELECT p.period, s.series, x.value FROM (SELECT DISTINCT period FROM {name}) p CROSS JOIN (SELECT DISTINCT series FROM {name}) s LEFT JOIN {name} x ON x.period = p.period AND x.series = s.series)"
