"""A running class distribution over arriving picks: windows on event time, late rows up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_distribution(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window start, class and count of a stream or table of (ts, event_type)."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")
