"""Tumbling counts over a stream of dated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, key: str, ts: str, days: int, late: str = "30 days") -> DataFrame:
    """Starts of each entity by span of days; spans close ``late`` after they end, so state stays bounded."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(key, F.window(ts, f"{days} days").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.start").alias("from_ts"), "n")
    )
