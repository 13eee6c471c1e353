"""The event log as a stream: windows per key with a watermark, and first claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", limit: int = 3) -> DataFrame:
    """Events of each user in fixed windows, with how many were within the limit. Works on streams and on tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    n = F.count("*")
    return e.groupBy(F.window("ts", width).alias("w"), "user_id").agg(n.alias("n"), F.least(n, F.lit(limit)).alias("allowed")).select("user_id", F.col("w.start").alias("start"), "n", "allowed")


def first_claims(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key while the watermark remembers it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)
