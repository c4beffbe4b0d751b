"""History, diffs and build output of a working copy that driver and executors see.

The driver asks for names alone; logs and diffs are read by tasks.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import valid_ref
from ..operators.textlog import commit_log, dependency_report, diff_ranges, untracked
from ..runtime import stash
from .commands import LINES, command_lines

#: Commits that one task reads.
PER_JOB = 2000


def _run(args: list[str], cwd: Path | str, check: bool = True) -> str:
    done = subprocess.run(args, cwd=cwd, capture_output=True, text=True, errors="replace")
    if check and done.returncode:
        raise RuntimeError(f"{args[0]} failed: {done.stderr.strip()[:200]}")
    return done.stdout


def text_lines(spark: SparkSession, source: str, text: str) -> DataFrame:
    """A text as ``(source, line_no, value)``."""
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(text.split("\n"))], LINES)


def repository_root(path: Path | str) -> Path:
    """The top folder of the working copy, or the folder itself outside one."""
    try:
        return Path(_run(["git", "rev-parse", "--show-toplevel"], path).strip())
    except (RuntimeError, OSError):
        return Path(path)


def history(spark: SparkSession, root: Path | str) -> DataFrame:
    """The commit log of a working copy, merges left out."""
    commits = _run(["git", "rev-list", "--no-merges", "HEAD"], root).split()
    args = ["git", "log", "--no-walk=unsorted", "--stdin", "--numstat", "--format=COMMIT %H %at"]
    jobs = [{"source": f"log{i}", "args": args, "stdin": "\n".join(commits[i : i + PER_JOB])} for i in range(0, len(commits), PER_JOB)]
    return commit_log(command_lines(spark, str(root), jobs))


def _succeeds(args: list[str], cwd: Path | str) -> bool:
    try:
        return subprocess.run(args, cwd=cwd, capture_output=True).returncode == 0
    except OSError:
        return False


def changes(spark: SparkSession, root: Path | str, ref: str) -> tuple[DataFrame, DataFrame]:
    """``(path, start, end)`` and added paths against a revision, working tree and untracked files included."""
    if not valid_ref(ref):
        raise ValueError(f"not a revision: {ref!r}")
    if not _succeeds(["git", "rev-parse", "--is-inside-work-tree"], root):
        raise RuntimeError("not a repository")
    if not _succeeds(["git", "rev-parse", "--verify", "--quiet", ref + "^{commit}"], root):
        raise ValueError(f"no revision {ref!r}")
    if not _succeeds(["git", "merge-base", ref, "HEAD"], root):
        raise ValueError(f"nothing in common with {ref!r}")
    diff = ["git", "diff", "--unified=0", "--no-color"]
    jobs = [{"source": "branch", "args": [*diff, f"{ref}...HEAD"]}, {"source": "tree", "args": [*diff, "HEAD"], "must": False}]  # what the second can't say is no change
    loose = [(f"untracked{i}", p) for i, p in enumerate(_run(["git", "ls-files", "--full-name", "--others", "--exclude-standard"], root, check=False).split("\n")) if p]
    all_rows = stash(diff_ranges(command_lines(spark, str(root), jobs)), "changes")
    all_rows = all_rows.unionByName(untracked(spark.createDataFrame(loose, "source string, path string")))
    return all_rows.select("path", "start", "end"), all_rows.filter("is_new").select("path").distinct()


def dependencies(spark: SparkSession, root: Path | str) -> DataFrame:
    """The dependency analyser's report; its exit status says nothing, only a missing command is an error."""
    return dependency_report(text_lines(spark, "build", _run(["mvn", "dependency:analyze", "--no-transfer-progress", "-B"], root, check=False))).select("kind", "coord", F.col("line_no"))
