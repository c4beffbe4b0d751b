"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver's own process may do
    without: it gets a folder of its own.  Elsewhere executors would write to
    disks that nobody else sees, so an unset folder is an error.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="plumbline-")
    sc.setCheckpointDir(place)
    return sc._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which ends its lineage there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stashed_at = path
    return found


def append(stashed: DataFrame, more: DataFrame) -> DataFrame:
    """Add rows to what :func:`stash` wrote, and read it all; frames read before don't see them."""
    path = stashed._stashed_at
    more.write.mode("append").parquet(path)
    found = stashed.sparkSession.read.schema(stashed.schema).parquet(path)
    found._stashed_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`stash` wrote for frames that nothing reads any more; other frames are passed over."""
    for df in frames:
        if path := getattr(df, "_stashed_at", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
