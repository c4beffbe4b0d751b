"""What sections and metrics mean, looked up without a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import topic_key

#: id, other names, title, one line, advice.  Fixed values: the ids and other names, by which users look topics up.
TOPICS = [
    ("complexity", ["cyclomatic", "cognitive", "high-complexity", "high-complexity-functions", "complexity-functions"], "Complex functions", "Cyclomatic: paths through a function (over 20; high from 30, critical from 50). Cognitive: effort to read it, more for nesting (over 15; 25; 40).", "Return early, name conditions, and give nested parts functions of their own."),
    ("large-functions", ["large", "long-functions", "long"], "Large functions", "Functions of more than 60 lines, longest first.", "Split where one step ends and the next begins."),
    ("hotspots", ["hotspot", "churn"], "Hotspots", "0 to 100: recent changes (half-life 90 days) times branches per line, against the greatest of the project.", "Simplify what changes most before adding to it."),
    ("circular", ["cycles", "circular-dependencies", "circular-deps", "circular-dependency"], "Import cycles", "Files that import each other, directly or around.", "Move what both sides need to a third place, or turn one dependency around."),
    ("unused-files", ["unused-file", "dead-files", "unreachable-files"], "Unused files", "Files that no test, program or framework entry point leads to.", "Remove them, or mark what finds them at run time."),
    ("unused-exports", ["unused-export", "dead-exports", "exports"], "Unused exports", "Public or protected methods that no other file names.", "Remove them or narrow their visibility."),
    ("duplicates", ["dupes", "duplicate-code", "clones", "clone", "duplication"], "Duplicates", "Blocks of at least 50 equal tokens over 5 lines.", "Give the shared block one home and call it."),
    ("clone-families", ["families", "clone-family", "clone-families"], "Clone families", "Sets of files that share several duplicates.", "Look for what the files have in common as a whole before moving single blocks."),
    ("deps", ["dependencies", "unused-dependencies", "undeclared-dependencies", "unused-deps", "maven"], "Dependencies", "Declared but unused, and used but undeclared libraries.", "Declare what is used; drop what isn't."),
    ("targets", ["refactoring-targets", "refactor", "refactoring", "target", "roi"], "Refactoring targets", "Gain by effort over all findings of a file.", "Begin at the top."),
    ("trend", ["trends", "fan-in", "density"], "Trend, fan-in and density", "Trend: changes in the later half of a file's history against the earlier. Fan-in: files that import it. Density: branches per line.", "Read them next to the hotspot score."),
]


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "id string, aliases array<string>, name string, legend string, advice string")


def find(table: DataFrame, query: str) -> DataFrame:
    """Topics by id or another name; case, spaces and underscores don't matter."""
    key = topic_key(F.lit(query))
    return table.filter((F.col("id") == key) | F.array_contains("aliases", key))
