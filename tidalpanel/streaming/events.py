"""Event-time windows over a stream; the batch queries of the same name use the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """New files of a folder as they land; the schema is that of the files there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time with its zone, as watermarks ask for."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    rows = _timed(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    rows = _timed(events, late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def write_parquet(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows only, exactly once; ends when the files there have been read."""
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
