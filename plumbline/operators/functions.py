"""Function-level findings: complexity and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exceeded, severity, severity_rank

LARGE = 60


def violations(functions: DataFrame, most_cyclomatic: int = 20, most_cognitive: int = 15) -> DataFrame:
    """Functions of ``(path, name, line, cyclomatic, cognitive, line_count)`` above either limit."""
    over = exceeded(F.col("cyclomatic"), F.col("cognitive"), most_cyclomatic, most_cognitive)
    return functions.select("path", "name", "line", "cyclomatic", "cognitive", "line_count", over.alias("exceeded"), severity(F.col("cyclomatic"), F.col("cognitive")).alias("severity")).filter(F.col("exceeded").isNotNull())


def violation_order() -> list:
    """Worst first, with a total order."""
    return [F.desc(F.when(F.col("exceeded") == "both", 2).otherwise(1)), F.desc(severity_rank(F.col("severity"))), F.desc("cyclomatic"), F.desc("cognitive"), F.desc("line_count"), F.asc("path"), F.asc("line"), F.asc("name")]


def large_functions(functions: DataFrame, most_lines: int = LARGE) -> DataFrame:
    return functions.filter(F.col("line_count") > most_lines).select("path", "name", "line", "line_count")


def large_order() -> list:
    return [F.desc("line_count"), F.asc("path"), F.asc("line"), F.asc("name")]
