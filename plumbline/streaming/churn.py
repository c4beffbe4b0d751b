"""Churn over a stream of changes.

A weight depends on when it is asked for, so the state keeps counts a key and
day; decay is applied when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import HALF_LIFE


def daily_counts(stream: DataFrame, key: str, ts: str, late: str = "2 days") -> DataFrame:
    """``(path, day, n)`` of a streaming or batch frame; rows later than ``late`` behind the newest are dropped by the stream."""
    rows = stream.select(F.col(key).alias("path"), F.col(ts).cast("timestamp").alias("ts"))
    if stream.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("path", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("day"), "n")


def decayed(daily: DataFrame, as_of: int, half_life: int = HALF_LIFE) -> DataFrame:
    """Weights at a moment from daily counts, by the start of each day."""
    weight = F.pow(F.lit(0.5), (F.lit(as_of) - F.unix_seconds("day")) / half_life)
    return daily.groupBy("path").agg(F.sum(F.col("n") * weight).alias("weighted_commits"), F.sum("n").alias("total_commits"))
