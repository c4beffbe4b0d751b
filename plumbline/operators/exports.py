"""Exports that no other file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_test_path


def unused_exports(exports: DataFrame, used: DataFrame) -> DataFrame:
    """Rows of ``(path, name, line)`` outside test folders whose name is in no other path of ``(path, name)``.

    The uses are first folded to one row a name (how many files, and which if
    one), so a frequent name costs one row in the join, not one a file.
    """
    folded = used.groupBy("name").agg(F.count_distinct("path").alias("files"), F.min("path").alias("only"))
    joined = exports.filter(~is_test_path(F.col("path"))).join(folded, "name", "left")
    return joined.filter(F.col("files").isNull() | (F.col("files") == 1) & (F.col("only") == F.col("path"))).select("path", "name", "line")
