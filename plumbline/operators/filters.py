"""What a report shows: globs hide, and a comparison keeps what was changed.

Filters run after the analyses, on their results: whole-corpus links stay as
they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import skipped
from .intervals import overlapping


@dataclass
class ReportFilter:
    """``ranges`` of (path, start, end) and ``added`` paths are None in a full report."""

    patterns: list[str] = field(default_factory=list)
    ranges: DataFrame | None = None
    added: DataFrame | None = None

    def _unskipped(self, df: DataFrame, path: str) -> DataFrame:
        return df.filter(~skipped(F.col(path), self.patterns)) if self.patterns else df

    def spans(self, df: DataFrame, path: str = "path", begin: str = "line", end: str = "line") -> DataFrame:
        """Rows whose lines overlap a change."""
        df = self._unskipped(df, path)
        return df if self.ranges is None else overlapping(df, self.ranges, path, begin, end)

    def functions(self, df: DataFrame) -> DataFrame:
        """Function rows, by their span of lines."""
        last = df.withColumn("__last", F.col("line") + F.greatest(F.col("line_count") - 1, F.lit(0)))
        return self.spans(last, "path", "line", "__last").drop("__last")

    def files(self, df: DataFrame, path: str = "path") -> DataFrame:
        """Rows of files with any change."""
        df = self._unskipped(df, path)
        return df if self.ranges is None else df.join(self.ranges.select(F.col("path").alias(path)).distinct(), path, "left_semi")

    def new_files(self, df: DataFrame, path: str = "path") -> DataFrame:
        """Rows of added files."""
        df = self._unskipped(df, path)
        return df if self.added is None else df.join(self.added.select(F.col("path").alias(path)).distinct(), path, "left_semi")

    def hotspots(self, df: DataFrame) -> DataFrame:
        """None in a comparison: churn says nothing of one change."""
        return self._unskipped(df, "file") if self.ranges is None else df.limit(0)

    def groups(self, members: DataFrame, group: list[str], lines: bool = False) -> DataFrame:
        """Group keys of which some member is unskipped and some member, maybe another, was changed.

        ``members`` has a path a row, and with ``lines`` start_line and end_line.
        """
        seen = members.filter(~skipped(F.col("path"), self.patterns)).select(*group).distinct()
        if self.ranges is None:
            return seen
        touched = overlapping(members, self.ranges, "path", "start_line", "end_line") if lines else members.join(self.ranges.select("path").distinct(), "path", "left_semi")
        return seen.join(touched.select(*group).distinct(), group, "left_semi")

    def dependencies(self, df: DataFrame) -> DataFrame:
        """Nothing in a comparison unless a build file was changed."""
        if self.ranges is None:
            return df
        touched = self.ranges.select("path").unionByName(self.added.select("path")) if self.added is not None else self.ranges.select("path")
        poms = touched.filter(F.col("path").endswith("pom.xml")).agg((F.count("*") > 0).alias("__pom"))
        return df.crossJoin(F.broadcast(poms)).filter("__pom").drop("__pom")
