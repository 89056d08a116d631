"""Readers and writers of the file layouts that panels come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first cell of the row that holds the transform codes.
MARK = "Transform:"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _date(column: str):
    c = F.col(column)
    return F.coalesce(F.try_to_timestamp(c, F.lit("M/d/yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def macro_panel(spark: SparkSession, path: str, date_column: str = "sasdate") -> DataFrame:
    """(period, series, value) of a wide file whose second line may hold codes; cells that are no numbers are null."""
    raw = _raw(spark, path)
    names = [c for c in raw.columns if c != date_column]
    rows = raw.filter(~F.col(date_column).eqNullSafe(MARK)).withColumn("period", _date(date_column)).filter("period is not null")
    return rows.unpivot(["period"], names, "series", "value").withColumn("value", F.col("value").try_cast("double"))


def transform_codes(spark: SparkSession, path: str, date_column: str = "sasdate") -> DataFrame:
    """(series, code); what is no number is code 1."""
    raw = _raw(spark, path)
    names = [c for c in raw.columns if c != date_column]
    rows = raw.filter(F.col(date_column) == MARK).limit(1).unpivot([date_column], names, "series", "code")
    return rows.select("series", F.coalesce(F.col("code").try_cast("double").cast("int"), F.lit(1)).alias("code"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return rows.select(F.col("fred").alias("series"), F.col("group").try_cast("int").alias("grp")).filter("series is not null")


def exclude(panel: DataFrame, meta: DataFrame, groups: list[int], names: list[str] = ()) -> DataFrame:
    """panel without the series of groups or names; a group that no series has is an error, not a silent no-op."""
    dropped = meta.filter(F.col("grp").isin(groups))
    missing = set(groups) - {r["grp"] for r in dropped.select("grp").distinct().collect()}
    if missing:
        raise ValueError(f"no series in groups {sorted(missing)}")
    return panel.join(dropped.select("series"), "series", "left_anti").filter(~F.col("series").isin(list(names)))


def prices(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    raw = _raw(spark, path)
    names = [c for c in raw.columns if c != "Date"]
    rows = raw.withColumn("period", _date("Date")).unpivot(["period"], names, "series", "value").withColumn("value", F.col("value").try_cast("double"))
    rows = rows.filter("period is not null and value is not null")
    return rows.filter(F.col("period") >= F.lit(start).cast("date")) if start else rows


def vintages(spark: SparkSession, folder: str, date_column: str = "sasdate") -> DataFrame:
    """(vintage, period, series, value) of a folder of files named by month, yyyy-MM.csv, with equal headers."""
    raw = spark.read.option("header", True).csv(f"{folder}/*.csv").withColumn("vintage", F.try_to_timestamp(F.concat(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2})", 1), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"))
    names = [c for c in raw.columns if c not in (date_column, "vintage")]
    rows = raw.filter(~F.col(date_column).eqNullSafe(MARK)).withColumn("period", _date(date_column)).filter("period is not null and vintage is not null")
    return rows.unpivot(["vintage", "period"], names, "series", "value").withColumn("value", F.col("value").try_cast("double"))


def vintage_as_of(all_vintages: DataFrame, when: str) -> DataFrame:
    """The panel as it was known: that of the latest vintage not after `when`."""
    known = all_vintages.filter(F.col("vintage") <= F.lit(when).cast("date"))
    latest = known.agg(F.max("vintage").alias("vintage"))
    return known.join(F.broadcast(latest), "vintage").drop("vintage")


def alias(panel: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of `old` also under `new`, where a period has no row of `new`."""
    renamed = panel.filter(F.col("series") == old).withColumn("series", F.lit(new))
    return panel.unionByName(renamed.join(panel.filter(F.col("series") == new).select("period"), "period", "left_anti").select(panel.columns))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    out = rows.select(_date(rows.columns[0]).alias("period"), *[F.col(c).try_cast("double").alias(c) for c in rows.columns[1:]])
    return out.filter("period is not null")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(panel: DataFrame, path: str, by: str = "series") -> None:
    """Partitioned Parquet: a query on few series reads few folders."""
    panel.repartition(by).sortWithinPartitions("period").write.mode("overwrite").partitionBy(by).parquet(path)
