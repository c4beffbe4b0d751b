"""Line-oriented text with carried state: history, diffs and build output.

Each takes ``(source, line_no, value)``.  A line's state is the last marker at
or above it: a window per source, so sources are parsed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import OPEN_END
from .ranking import first_seen


def carried(marker: Column) -> Column:
    """The last non-null marker of the source so far."""
    return F.last(marker, ignorenulls=True).over(Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def commit_log(lines: DataFrame, suffix: str = ".java") -> DataFrame:
    """``(source, commit, ts, path, added, deleted)`` of ``COMMIT hash seconds`` headers and numeric stat lines.

    Binary files, other suffixes and lines under a header without a time are passed over.
    """
    header = F.col("value").startswith("COMMIT ")
    words = F.split("value", " ")
    marked = lines.withColumn("head", carried(F.when(header, F.struct(F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("commit"), F.coalesce(F.expr("try_cast(trim(try_element_at(split(value, ' '), 3)) as bigint)"), F.lit(0)).alias("ts")))))
    f = F.split("value", "\t", 3)
    rows = marked.filter(~header & (F.size(f) == 3)).select("source", F.col("head.commit").alias("commit"), F.col("head.ts").alias("ts"), F.trim(f[2]).alias("path"), F.expr("try_cast(split(value, '\t', 3)[0] as bigint)").alias("added"), F.expr("try_cast(split(value, '\t', 3)[1] as bigint)").alias("deleted"))
    return rows.filter(F.col("path").endswith(suffix) & F.col("added").isNotNull() & F.col("deleted").isNotNull() & (F.col("ts") > 0))


def diff_ranges(lines: DataFrame) -> DataFrame:
    """``(source, path, start, end, is_new)`` of the hunks of unified diffs without context.

    A header counts only before the first hunk of its file, so content that looks like one doesn't mislead.
    """
    v = F.col("value")
    begins = v.startswith("diff --git")
    hunk = v.startswith("@@")
    own = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("file", F.count(F.when(begins, 1)).over(own))
    within = Window.partitionBy("source", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = numbered.withColumn("hunks", F.count(F.when(hunk, 1)).over(within))
    target = F.when((F.col("hunks") == 0) & v.startswith("+++ "), F.regexp_replace(F.trim(F.substring(v, 5, 1 << 20)), "^b/", ""))
    state = state.withColumn("path", F.last(target, ignorenulls=True).over(within)).withColumn("is_new", F.coalesce(F.bool_or(F.when(F.col("hunks") == 0, v.startswith("new file mode"))).over(within), F.lit(False)))
    start, count = F.regexp_extract(v, r"\+(\d+)", 1), F.regexp_extract(v, r"\+\d+,(\d+)", 1)
    rows = state.filter(hunk & F.col("path").isNotNull() & (F.col("path") != "/dev/null")).select("source", "path", start.try_cast("long").alias("start"), F.when(count == "", 1).otherwise(count.try_cast("long")).alias("n"), "is_new")
    # Numbers beyond any file's lines make a hunk that says nothing.
    rows = rows.filter(F.col("start").between(0, OPEN_END) & F.col("n").between(1, OPEN_END)).withColumn("end", F.least(F.col("start") + F.col("n") - 1, F.lit(OPEN_END)))
    return rows.select("source", "path", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "is_new")


def untracked(paths: DataFrame) -> DataFrame:
    """Untracked files are new from the first line to the last."""
    return paths.select("source", "path", F.lit(1).alias("start"), F.lit(OPEN_END).alias("end"), F.lit(True).alias("is_new"))


def dependency_report(lines: DataFrame) -> DataFrame:
    """``(source, kind, coord, line_no)`` of unused and undeclared coordinates, each where it came first.

    Any line that is neither a header nor a coordinate ends the list.
    """
    bare = F.regexp_replace("value", r"^\s*(?:\[WARNING\])*(?:\[INFO\])*\s*|\s+$", "")
    gav = ~bare.rlike(r"\s") & (F.size(F.split(bare, ":")) >= 4)
    mode = F.when(bare.endswith("Used undeclared dependencies found:"), "undeclared").when(bare.endswith("Unused declared dependencies found:"), "unused").when(~gav, "none")
    state = lines.select("source", "line_no", "value").withColumn("mode", carried(mode))
    rows = state.filter(gav & F.col("mode").isin("undeclared", "unused") & mode.isNull()).select("source", F.col("mode").alias("kind"), F.concat_ws(":", F.split(bare, ":")[0], F.split(bare, ":")[1]).alias("coord"), "line_no")
    return first_seen(rows, ["source", "kind", "coord"], "line_no")
