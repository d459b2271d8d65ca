"""Structured Streaming forms of sessions, hourly counts and the log fold. Each returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sessions(events: DataFrame, *, key: str, time: str, gap: str = "1800 seconds", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n_events): sessions closed by inactivity and the watermark. Events exactly the gap apart stay together."""
    w = F.session_window(time, gap)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("start"), F.max(time).alias("end"))
    return grouped.select(key, "start", "end", "n_events")


def hourly_counts(events: DataFrame, *, page: str, time: str, late: str = "1 hour") -> DataFrame:
    """(page, hour, n): events of each page and hour."""
    return events.withWatermark(time, late).groupBy(page, F.window(time, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(page, F.col("w.start").alias("hour"), "n")


def latest(log: DataFrame, *, key: str, time: str, value: str) -> DataFrame:
    """(key, value): the last value of each key so far; for the complete or update mode."""
    return log.groupBy(key).agg(F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("s")).select(key, F.col("s.v").alias(value))
