"""Streaming bars: events to OHLCV by watermark and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events arriving as Parquet files in a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def windowed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(symbol, d, open, high, low, close, volume) per event type and window;
    events later than ``late`` are dropped once their window has closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    return by.agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    ).select("symbol", F.col("w.start").alias("d"), "open", "high", "low", "close", "volume")
