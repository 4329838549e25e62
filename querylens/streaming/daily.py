"""Beyond the reference: daily volume and exact dedup over a stream. Gates stay in batch, since they need the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_volume(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, event_type, n) as days close; events later than that after the latest seen are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, key: list[str], within: str = "1 hour") -> DataFrame:
    """Events whose key has not been seen within a while; state is dropped with the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)
