"""Refactoring targets: facts, thresholds, a first-match rule cascade and return on effort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from .ranking import nearest_rank

#: name -> (column, share, least value)
PERCENTILES = {
    "in_p95": ("fan_in", 0.95, 5),
    "in_p75": ("fan_in", 0.75, 3),
    "in_p25": ("fan_in", 0.25, 2),
    "out_p95": ("fan_out", 0.95, 8),
    "out_p90": ("fan_out", 0.90, 5),
}


def thresholds(facts: DataFrame) -> DataFrame:
    """One row of percentiles over all files, before any filter."""
    return nearest_rank(facts, PERCENTILES)


def assemble(files: DataFrame, hotspots: DataFrame, members: DataFrame, unused: DataFrame) -> DataFrame:
    """One row of facts a file.

    ``files``: path, lines, density, max_cognitive, function_count,
    export_count, fan_in, fan_out, is_root.  ``hotspots``: file, score, trend.
    ``members``: path of files in a cycle.  ``unused``: unused exports by path.
    """
    hot = hotspots.select(F.col("file").alias("path"), F.col("score").alias("hotspot"), "trend")
    ring = members.select("path").distinct().withColumn("is_circular", F.lit(True))
    dead = unused.groupBy("path").agg(F.count("*").alias("dead"))
    joined = files.join(hot, "path", "left").join(ring, "path", "left").join(dead, "path", "left")
    ratio = F.when(F.col("export_count") > 0, F.coalesce("dead", F.lit(0)) / F.when(F.col("export_count") > 0, F.col("export_count"))).otherwise(F.lit(0.0))
    return joined.select(*files.columns, F.coalesce("hotspot", F.lit(0.0)).alias("hotspot"), F.coalesce("trend", F.lit("stable")).alias("trend"), F.coalesce("is_circular", F.lit(False)).alias("is_circular"), ratio.alias("dead_ratio"))


def targets(facts: DataFrame) -> DataFrame:
    """Files that some rule names, with priority, effort and efficiency; the first matching rule counts."""
    c = F.col
    rules = [
        ((c("hotspot") >= 50) & (c("trend") == "accelerating") & (c("density") > 0.5), "churn+complexity", "low", F.lit("Settle this file first: it changes ever more often and is dense with branches")),
        (c("is_circular") & (c("fan_in") >= 5), "circular dependency", "high", F.lit("Cut the import cycle; many files depend on this one")),
        ((c("density") > 0.3) & ((c("fan_in") >= c("in_p95")) | (c("fan_in") >= c("in_p75")) & (c("function_count") >= 5)), "high impact", "medium", F.lit("Divide this complex file that much depends on")),
        ((c("dead_ratio") >= 0.5) & (c("export_count") >= 3), "dead code", "high", F.concat(F.lit("Take out public methods nobody calls ("), F.floor(c("dead_ratio") * 100 + 0.5).cast("string"), F.lit("% unused)"))),
        (c("max_cognitive") >= 30, "complexity", "high", F.lit("Break its hardest functions into smaller ones")),
        (~c("is_root") & (c("fan_out") >= c("out_p90")), "coupling", "medium", F.lit("Reduce what this file depends on")),
        (c("is_circular"), "circular dependency", "high", F.lit("Cut the import cycle")),
    ]
    chosen = None
    for when, category, confidence, advice in rules:
        row = F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), advice.alias("recommendation"))
        chosen = F.when(when, row) if chosen is None else chosen.when(when, row)
    raw = F.least(c("density"), F.lit(1.0)) * 30 + c("hotspot") / 100 * 25 + c("dead_ratio") * 20 + F.least(c("fan_in") / c("in_p95"), F.lit(1.0)) * 15 + F.least(c("fan_out") / c("out_p95"), F.lit(1.0)) * 10
    effort = F.when((c("lines") >= 500) | (c("fan_in") >= c("in_p95")) | (c("function_count") >= 15) & (c("density") > 0.5), 3).when((c("lines") < 100) & (c("function_count") <= 3) & (c("fan_in") < c("in_p25")), 1).otherwise(2)
    found = facts.crossJoin(F.broadcast(thresholds(facts))).withColumn("rule", chosen).filter(c("rule").isNotNull())
    found = found.withColumn("priority", rounded(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)))).withColumn("cost", effort)
    return found.select("path", "priority", rounded(c("priority") / c("cost")).alias("efficiency"), c("rule.recommendation").alias("recommendation"), c("rule.category").alias("category"), F.when(c("cost") == 1, "low").when(c("cost") == 3, "high").otherwise("medium").alias("effort"), c("rule.confidence").alias("confidence"))


def target_order() -> list:
    return [F.desc("efficiency"), F.desc("priority"), F.asc("path")]
