"""The command line: ``python -m plumbline.plans.cli [command] [options]``."""

from __future__ import annotations

import argparse
import math
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import Config, option_list
from ..operators.filters import ReportFilter
from ..sources import files, history
from .report import render, table
from .scan import COMMANDS, Scan
from .topics import find, topics


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Code-health analytics on Spark")
    p.add_argument("command", nargs="?", default="all", choices=[*COMMANDS, "explain"])
    p.add_argument("topic", nargs="*", default=[])
    p.add_argument("--root", default=".")
    p.add_argument("--fail-on", default="nullpointers")
    p.add_argument("--max-complexity", type=int, default=20)
    p.add_argument("--max-cognitive", type=int, default=15)
    p.add_argument("--max-hotspot-score", type=float, default=math.inf)
    p.add_argument("--skip-compile", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--min-commits", type=int, default=1)
    p.add_argument("--min-tokens", type=int, default=50)
    p.add_argument("--min-lines", type=int, default=5)
    p.add_argument("--no-legend", action="store_true")
    p.add_argument("--skip-pattern", default="")
    p.add_argument("--compare-against")
    p.add_argument("--as-of", type=int)
    return p


def config_of(a: argparse.Namespace) -> Config:
    return Config(option_list(a.fail_on), a.max_complexity, a.max_cognitive, a.max_hotspot_score, a.skip_compile, a.verbose, a.top, a.min_commits, a.min_tokens, a.min_lines, not a.no_legend, option_list(a.skip_pattern), a.compare_against, a.as_of)


def main(argv: list[str] | None = None) -> int:
    """0: all gates pass; 1: a gate fails; 2: no project."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "explain":
        found = find(topics(spark), " ".join(a.topic))
        print(table(found if not found.isEmpty() else topics(spark).select("id", "name")))
        return 0
    project = files.find_project(a.root)
    if project is None:
        print(f"no {files.BUILD_FILE} here or up to five folders above", file=sys.stderr)
        return 2
    config, root = config_of(a), history.repository_root(project)
    below = Path(project).resolve().relative_to(root.resolve()).as_posix() if root.resolve() in [Path(project).resolve(), *Path(project).resolve().parents] else "."
    sources = files.source_files(spark, str(project))
    if below != ".":
        from pyspark.sql import functions as F

        sources = sources.withColumn("path", F.concat(F.lit(below + "/"), "path"))
    shown = ReportFilter(config.skip_patterns)
    if config.compare_against:
        try:
            shown = ReportFilter(config.skip_patterns, *history.changes(spark, root, config.compare_against))
        except (RuntimeError, ValueError, OSError) as e:
            print(f"no comparison ({e}); this is the whole report", file=sys.stderr)
    log = None
    if a.command in ("all", "hotspots", "targets"):
        try:
            log = history.history(spark, root)
        except (RuntimeError, OSError) as e:
            print(f"no history ({e})", file=sys.stderr)
    deps = history.dependencies(spark, project) if a.command == "deps" else None
    scan = Scan(sources, log, config, shown, deps, str(root))
    print(render(scan, a.command))
    failed = scan.gates(COMMANDS[a.command]).filter("failed").collect()
    for row in failed:
        print(f"failed: {row['target']}: {row['message']}")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
