"""Structured Streaming forms of the event reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", files: str = "events.parquet") -> DataFrame:
    """New files of events as a stream; several files are taken in the order of their age."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", files).parquet(folder)


def windowed_activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, users (approximate), value by event time. Works on streams and tables; a stream drops what comes later than `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    counted = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(19,4)")).cast("decimal(19,4)").alias("value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "users", "value")
