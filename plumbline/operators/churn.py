"""Recency-weighted churn and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decay, rounded, steady_sum, trend


def churn(log: DataFrame, as_of: int, key: str = "path", ts: str = "ts", added: str = "added", deleted: str = "deleted") -> DataFrame:
    """One row for each key of a log: decayed and plain counts, line sums and trend.

    Two hash aggregations on the same key, so one shuffle: the second counts
    either side of the key's own midpoint, for which rows are first summed by
    (key, second).  Weights are taken relative to the key's last second and
    added exactly, so equal histories weigh the same to the last bit.
    """
    rows = log.select(F.col(key).alias("path"), F.col(ts).alias("ts"), F.col(added).alias("added"), F.col(deleted).alias("deleted")).filter(F.col("ts").isNotNull())
    seconds = rows.groupBy("path", "ts").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    spans = seconds.groupBy("path").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)
    found = seconds.join(spans, "path").groupBy("path", "low", "high").agg(
        (decay(F.col("high"), as_of) * steady_sum(F.col("n"), decay(F.col("ts"), F.col("high")))).alias("weighted_commits"),
        F.sum("n").alias("total_commits"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.sum(F.when(F.col("ts") > middle, F.col("n")).otherwise(0)).alias("recent"),
    )
    older = F.col("total_commits") - F.col("recent")
    return found.withColumn("trend", trend(F.col("recent"), older, F.col("total_commits"), F.col("low"), F.col("high"))).drop("recent", "low", "high")


def hotspots(churned: DataFrame, metrics: DataFrame | None = None, min_commits: int = 1) -> DataFrame:
    """Scores 0 to 100: decayed churn times density, each as a share of the greatest.

    ``metrics`` has path, density, loc and fan_in; what it lacks counts as
    zero.  The minimum of commits applies before the shares.  The two maxima
    are a one-row aggregate joined back, so no single task holds all rows.
    """
    kept = churned.filter(F.col("total_commits") >= min_commits)
    if metrics is None:
        kept = kept.withColumns({"density": F.lit(0.0), "loc": F.lit(0).cast("long"), "fan_in": F.lit(0).cast("long")})
    else:
        kept = kept.join(metrics.select("path", "density", "loc", "fan_in"), "path", "left")
        kept = kept.withColumns({"density": F.coalesce("density", F.lit(0.0)), "loc": F.coalesce("loc", F.lit(0)).cast("long"), "fan_in": F.coalesce("fan_in", F.lit(0)).cast("long")})
    most = kept.agg(F.max("weighted_commits").alias("most_weight"), F.max("density").alias("most_density"))
    share = F.col("weighted_commits") / F.col("most_weight") * (F.col("density") / F.col("most_density")) * 100
    score = F.when((F.col("most_weight") > 0) & (F.col("most_density") > 0), rounded(share)).otherwise(F.lit(0.0))
    return kept.crossJoin(F.broadcast(most)).select(
        F.col("path").alias("file"),
        score.alias("score"),
        rounded(F.col("weighted_commits"), 2).alias("weighted_commits"),
        "total_commits",
        "loc",
        (F.col("added") + F.col("deleted")).alias("churn_lines"),
        rounded(F.col("density"), 2).alias("density"),
        "fan_in",
        "trend",
    )
