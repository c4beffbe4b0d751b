"""Source trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frontend.facts import parse_file
from ..frontend.lexer import clone_tokens

# Folders that are never entered, and the build file that marks a project.
PRUNED = frozenset(("target", "build", "out", ".git", "node_modules", "generated"))
BUILD_FILE = "pom.xml"

FILES = """path string, package string, imports array<string>, wildcard_imports array<string>, static_imports array<string>,
types array<struct<fqn: string, simple: string, line: int, is_public: boolean>>, referenced array<string>, used_names array<string>, annotations array<string>,
exports array<struct<name: string, line: int>>,
functions array<struct<name: string, line: int, col: int, cyclomatic: int, cognitive: int, line_count: int, param_count: int>>, line_count int"""
TOKENS = "path string, keys array<string>, lines array<int>"


def find_project(start: str | Path) -> Path | None:
    """The nearest folder with a build file, from ``start`` up to five folders above it."""
    here = Path(start).resolve()
    return next((p for p in [here, *here.parents][:6] if (p / BUILD_FILE).is_file()), None)


def _entries(folder: str, suffix: str) -> tuple[list[str], list[str]]:
    """Folders to enter and sources in one folder, in order; none if it can't be read."""
    folders, found = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in PRUNED:
                        folders.append(e.path)
                elif e.name.endswith(suffix) and e.name != suffix and e.is_file():
                    found.append(e.path)
    except OSError:
        return [], []
    return sorted(folders), sorted(found)


def walk_sources(folders: list[str], suffix: str = ".java") -> Iterator[str]:
    """Paths of sources in and below folders."""
    waiting = list(reversed(folders))
    while waiting:
        below, found = _entries(waiting.pop(), suffix)
        yield from found
        waiting += reversed(below)


def split_tree(root: str, suffix: str = ".java", least: int = 256) -> tuple[list[str], list[str]]:
    """Sources of the upper levels of a tree, and the folders below them: the first level of ``least`` folders or more, or what there is.

    The driver lists no more than these levels.  A root that bears a pruned
    name has nothing.
    """
    if Path(root).resolve().name in PRUNED:
        return [], []
    folders, found = [str(root)], []
    while folders and len(folders) < least:
        levels = [_entries(f, suffix) for f in folders]
        folders = [f for below, _ in levels for f in below]
        found += [p for _, own in levels for p in own]
    return found, folders


class _Slice(InputPartition):
    def __init__(self, paths: list[str], folders: list[str]):
        super().__init__(None)
        self.paths, self.folders = paths, folders


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str, per_slice: int):
        self.root, self.suffix, self.per_slice = root, suffix, per_slice

    def partitions(self) -> list[InputPartition]:
        paths, folders = split_tree(self.root, self.suffix)
        return [*[_Slice(paths[i : i + self.per_slice], []) for i in range(0, len(paths), self.per_slice)], *[_Slice([], [f]) for f in folders]] or [_Slice([], [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in chain(partition.paths, walk_sources(partition.folders, self.suffix)):
            try:
                text = Path(path).read_bytes().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue  # what can't be read is no source
            yield os.path.relpath(path, self.root), text


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("root", ...)``: path below the root, and content."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["root"], self.options.get("suffix", ".java"), int(self.options.get("filesPerPartition", 200)))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """The tree's sources; the tree must be visible to executors."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", str(root)).load()


def line_counts(paths: DataFrame, root: str) -> DataFrame:
    """``(path, loc)`` of files below a root that executors see; none for what can't be read as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path in batch.column(0).to_pylist():
                try:
                    counts.append(Path(root, path).read_bytes().decode("utf-8").count("\n") + 1)
                except (OSError, UnicodeDecodeError, ValueError):
                    counts.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["path", "loc"])

    return paths.select("path").mapInArrow(run, "path string, loc long")


def _arrow(row_schema: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(row_schema))


def parse_sources(sources: DataFrame) -> DataFrame:
    """``(path, content)`` to the files table: one Arrow stage, no shuffle; null contents are passed over."""
    schema = _arrow(FILES, sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_file(p, t) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("path", "content").mapInArrow(run, FILES)


def tokenize_sources(sources: DataFrame) -> DataFrame:
    """``(path, content)`` to the tokens table for clone detection."""
    schema = _arrow(TOKENS, sources.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    found = clone_tokens(text)
                    rows.append({"path": path, "keys": [k for k, _ in found], "lines": [x for _, x in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("path", "content").mapInArrow(run, TOKENS)
