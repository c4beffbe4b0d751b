"""Pass or fail by what the sections hold."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import counted

# Target, noun, and what follows the count.
TARGETS = {
    "hotspots": ("file", " above the hotspot limit"),
    "complexity": ("complex function", " above the limit"),
    "large-functions": ("large function", ""),
    "circular": ("circular dependency", ""),
    "unused-files": ("unused file", ""),
    "unused-exports": ("unused export", ""),
    "duplicates": ("duplicate block", ""),
}


def gates(spark: SparkSession, fail_on: list[str], sections: dict[str, DataFrame], most_score: float = math.inf) -> DataFrame:
    """``(target, n, failed, message)`` of the targets asked for.

    Counts are of the filtered sections before any top-k.  A section that
    wasn't run is empty; targets nobody knows are passed over; the hotspot gate
    needs a finite limit; bug findings are always empty.
    """
    rows = []
    for target in dict.fromkeys(fail_on):
        if target in ("nullpointers", "bugs", "all"):
            rows.append(spark.range(1).select(F.lit(target).alias("target"), F.lit(0).cast("long").alias("n")))
        if target not in TARGETS or target == "hotspots" and math.isinf(most_score):
            continue
        if (df := sections.get(target)) is None:
            found = spark.range(1).select(F.lit(0).cast("long").alias("n"))
        else:
            found = (df.filter(F.col("score") > most_score) if target == "hotspots" else df).agg(F.count("*").alias("n"))
        rows.append(found.select(F.lit(target).alias("target"), "n"))
    schema = "target string, n long"
    table = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], schema)
    text = F.lit(None).cast("string")
    for target, (noun, rest) in TARGETS.items():
        text = F.when(F.col("target") == target, F.concat(counted(F.col("n"), noun), F.lit(rest))).otherwise(text)
    return table.select("target", "n", (F.col("n") > 0).alias("failed"), F.when(F.col("n") > 0, text).alias("message"))
