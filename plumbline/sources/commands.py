"""Output of commands as tables: each job runs where its partition is read, and its lines are passed on as they come."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "source string, line_no long, value string"


class _Job(InputPartition):
    def __init__(self, source: str, args: list[str], stdin: str = "", must: bool = True):
        super().__init__(None)
        self.source, self.args, self.stdin, self.must = source, args, stdin, must


class _Reader(DataSourceReader):
    def __init__(self, folder: str, jobs: list[dict[str, Any]]):
        self.folder, self.jobs = folder, jobs

    def partitions(self) -> list[InputPartition]:
        return [_Job(**job) for job in self.jobs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with tempfile.TemporaryFile("w+") as given, tempfile.TemporaryFile("w+", errors="replace") as complaints:
            given.write(partition.stdin)
            given.seek(0)
            with subprocess.Popen(partition.args, cwd=self.folder, stdin=given, stdout=subprocess.PIPE, stderr=complaints, text=True, errors="replace") as running:
                for number, line in enumerate(running.stdout):
                    yield partition.source, number, line.rstrip("\n")
            if partition.must and running.returncode:
                complaints.seek(0)
                raise RuntimeError(f"{partition.args[0]} failed: {complaints.read(200).strip()}")


class CommandLines(DataSource):
    """``spark.read.format("command_lines")`` with the options ``folder`` and ``jobs``: JSON, a list of source, args, stdin and must."""

    @classmethod
    def name(cls) -> str:
        return "command_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["folder"], json.loads(self.options["jobs"]))


def command_lines(spark: SparkSession, folder: str, jobs: list[dict[str, Any]]) -> DataFrame:
    """``(source, line_no, value)`` of the jobs' output; the folder must be visible to executors."""
    spark.dataSource.register(CommandLines)
    if not jobs:
        return spark.createDataFrame([], LINES)
    return spark.read.format("command_lines").option("folder", str(folder)).option("jobs", json.dumps(jobs)).load()
