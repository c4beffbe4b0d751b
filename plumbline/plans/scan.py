"""A scan: named, lazily built sections over a project's tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import churn, clones, exports, functions, graph, targets
from ..operators.filters import ReportFilter
from ..operators.gates import gates
from ..operators.ranking import grouped_top, top
from ..runtime import stash
from ..sources.files import line_counts, parse_sources, tokenize_sources


@dataclass
class Scan:
    """Sections of ``sources`` (path, content) and a commit ``log``; each is a frame that runs when it is asked for."""

    sources: DataFrame
    log: DataFrame | None = None
    config: Config = Config()
    shown: ReportFilter | None = None
    dependency_rows: DataFrame | None = None
    root: str | None = None  # of the working copy, where files that aren't among the sources are counted

    def __post_init__(self):
        self.shown = self.shown or ReportFilter(self.config.skip_patterns)
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def files(self) -> DataFrame:
        """Parsed once, then read from the shared folder by every section."""
        return stash(parse_sources(self.sources), "files")

    @cached_property
    def functions(self) -> DataFrame:
        return self.files.select("path", F.explode("functions").alias("f")).select("path", "f.*")

    @cached_property
    def edges(self) -> DataFrame:
        types = self.files.select("path", F.explode("types").alias("t")).select(F.col("t.fqn").alias("fqn"), "path")
        return stash(graph.import_edges(self.files, types), "edges")

    @cached_property
    def facts(self) -> DataFrame:
        own = graph.file_facts(self.files)
        nodes = own.select(F.col("path").alias("id"))
        found = graph.degrees(nodes, self.edges).withColumnRenamed("id", "path")
        roots = graph.with_fallback_roots(own.select(F.col("path").alias("id"), "is_root", "is_public")).withColumnRenamed("id", "path")
        return stash(own.drop("is_root", "is_public").join(found, "path").join(roots, "path"), "facts")

    @cached_property
    def _hotspots(self) -> DataFrame:
        if self.log is None:
            return self.files.sparkSession.createDataFrame([], "file string, score double, weighted_commits double, total_commits long, loc long, churn_lines long, density double, fan_in long, trend string")
        as_of = self.config.as_of if self.config.as_of is not None else int(time.time())
        changed = churn.churn(self.log, as_of)
        metrics = self.facts.select("path", "density", F.col("lines").cast("long").alias("loc"), "fan_in")
        if self.root is not None:
            others = line_counts(changed.join(metrics, "path", "left_anti"), self.root)
            metrics = metrics.unionByName(others.select("path", F.lit(0.0).alias("density"), "loc", F.lit(0).cast("long").alias("fan_in")))
        return churn.hotspots(changed, metrics, self.config.min_commits)

    @cached_property
    def _members(self) -> DataFrame:
        return stash(graph.strong_components(self.edges), "members")

    @cached_property
    def _unused_exports(self) -> DataFrame:
        own = self.files.select("path", F.explode("exports").alias("e")).select("path", "e.*")
        used = self.files.select("path", F.explode("used_names").alias("name"))
        return exports.unused_exports(own, used)

    @cached_property
    def _clones(self) -> DataFrame:
        return stash(clones.clone_groups(stash(tokenize_sources(self.sources), "tokens"), self.config.min_tokens, self.config.min_lines), "clones")

    # --- sections, filtered and untruncated ---

    def hotspots(self) -> DataFrame:
        return self.shown.hotspots(self._hotspots)

    def complexity(self) -> DataFrame:
        return self.shown.functions(functions.violations(self.functions, self.config.max_complexity, self.config.max_cognitive))

    def large_functions(self) -> DataFrame:
        return self.shown.functions(functions.large_functions(self.functions))

    def circular(self) -> DataFrame:
        keys = self.shown.groups(self._members.select(F.col("id").alias("path"), "scc"), ["scc"])
        return graph.cycles(self._members.join(keys, "scc", "left_semi"), self.files.select(F.col("path").alias("id"), "package"))

    def unused_files(self) -> DataFrame:
        nodes = self.facts.select(F.col("path").alias("id"), "is_root")
        reached = graph.reachable(nodes.filter("is_root").select("id"), self.edges)
        return self.shown.new_files(graph.unused_nodes(nodes, reached).withColumnRenamed("id", "path"))

    def unused_exports(self) -> DataFrame:
        return self.shown.spans(self._unused_exports)

    def duplicates(self) -> DataFrame:
        keys = self.shown.groups(self._clones, ["group_id"], lines=True)
        return self._clones.join(keys, "group_id", "left_semi")

    def families(self) -> DataFrame:
        found = clones.families(self._clones).withColumn("family", F.xxhash64("files"))
        keys = self.shown.groups(found.select("family", F.explode("files").alias("path")), ["family"])
        return found.join(keys, "family", "left_semi").drop("family")

    def deps(self) -> DataFrame:
        rows = self.dependency_rows
        return self.shown.dependencies(rows if rows is not None else self.sources.sparkSession.createDataFrame([], "kind string, coord string, line_no long"))

    def targets(self) -> DataFrame:
        facts = targets.assemble(self.facts.drop("is_public"), self._hotspots, self._members.select(F.col("id").alias("path")), self._unused_exports)
        return self.shown.files(targets.targets(facts))

    def section(self, name: str) -> DataFrame:
        """A section, made once: its count, its top rows and its gate read the same table."""
        if name not in self._made:
            self._made[name] = stash(getattr(self, name.replace("-", "_"))(), f"section-{name}")
        return self._made[name]

    def top(self, name: str) -> DataFrame:
        """The rows a report shows: the section's order, cut to ``config.top``; functions and exports are grouped by file."""
        df, n = self.section(name), self.config.top
        if name == "complexity":
            return grouped_top(df, "path", functions.violation_order(), n).orderBy("place")
        if name == "large-functions":
            return grouped_top(df, "path", functions.large_order(), n).orderBy("place")
        if name == "unused-exports":
            return grouped_top(df, "path", [F.asc("path"), F.asc("line"), F.asc("name")], n).orderBy("place")
        orders = {
            "hotspots": [F.desc("score"), F.asc("file")],
            "circular": [F.asc("size"), F.asc("files")],
            "unused-files": [F.asc("path")],
            "duplicates": [F.desc("line_count"), F.desc("token_count"), F.asc("group_id"), F.asc("path"), F.asc("start_line")],
            "families": [F.desc("total_lines"), F.desc("group_count"), F.asc("files")],
            "targets": targets.target_order(),
        }
        return df.orderBy("line_no") if name == "deps" else top(df, orders[name], n)

    def gates(self, names: list[str]) -> DataFrame:
        """Pass or fail of the sections that were run."""
        sections = {n: self.section(n) for n in names if n not in ("families", "deps", "targets")}
        if "duplicates" in sections:
            sections["duplicates"] = sections["duplicates"].select("group_id").distinct()
        return gates(self.sources.sparkSession, self.config.fail_on, sections, self.config.max_hotspot_score)


#: Sections of each command; a whole scan leaves out what needs the build tool.
COMMANDS = {
    "all": ["hotspots", "complexity", "large-functions", "circular", "unused-files", "unused-exports", "duplicates", "families", "targets"],
    "hotspots": ["hotspots"],
    "complexity": ["complexity", "large-functions"],
    "circular": ["circular"],
    "unused-files": ["unused-files"],
    "unused-exports": ["unused-exports"],
    "deps": ["deps"],
    "dupes": ["duplicates", "families"],
    "targets": ["targets"],
    "bugs": [],
    "dead-code": [],
}
