"""Exact deduplication by two-pass Bloom filtering.

The first pass puts every text's digest into a Bloom filter whose cells count
to two.  In the second pass a row none of whose copies can exist (some cell of
it was hit once only) goes straight through; only rows whose cells were all
hit twice are shuffled, on the whole SHA-256 digest, to settle what the filter
left open.  A false positive therefore costs a shuffled row and never a wrong
answer.

The filter grows with the row count up to ``max_cells`` (32 MB broadcast as
bits); beyond it more rows take the shuffled way.  Tasks send the cells that
they hit, so the filter's making costs a few bytes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

HASHES = 2
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
CHUNK = 1 << 16  # cells that one merging call holds


def _cells(first: np.ndarray, second: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of each digest: double hashing over a power of two of cells."""
    a, b = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)]


def _halves(digest: str = "text_sha256"):
    """Two 63-bit numbers from a hexadecimal digest, inside the JVM."""
    return [F.conv(F.substring(F.col(digest), at, 15), 16, 10).cast("long") for at in (1, 17)]


def repeated_filter(digests: DataFrame, rows: int, max_cells: int = MAX_CELLS) -> tuple[np.ndarray, int]:
    """First pass over ``(first, second)``: the packed bits of the cells that at least two rows hit, and the number of cells."""
    cells = max(CHUNK, min(max_cells, 1 << max(1, CELLS_PER_ROW * rows - 1).bit_length()))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for i, parts in seen.items():
                # A cell that this task hits more often is sent twice, which is enough to know.
                found, counts = np.unique(np.concatenate(parts), return_counts=True)
                for chunk, at in ((c, found // CHUNK == c) for c in np.unique(found // CHUNK)):
                    local = np.repeat(found[at] % CHUNK, np.minimum(counts[at], 2)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([i * (cells // CHUNK) + int(chunk)], pa.int64()), pa.array([local.tobytes()], pa.binary())], names=["chunk", "hits"])
            seen.clear()

        for batch in batches:
            for i, x in enumerate(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells)):
                seen.setdefault(i, []).append(x)
            held += batch.num_rows
            if held >= 1 << 20:
                yield from flush()
                held = 0
        yield from flush()

    def merge(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(CHUNK, np.int64)
        for part in groups:
            for hits in part["hits"]:
                counts += np.bincount(np.frombuffer(hits, np.uint16), minlength=CHUNK)
        yield pd.DataFrame({"chunk": [key[0]], "twice": [np.packbits(counts >= 2).tobytes()]})

    twice = digests.mapInArrow(hit, "chunk long, hits binary").groupBy("chunk").applyInPandas(merge, "chunk long, twice binary")
    bits = np.zeros((HASHES, cells // 8), np.uint8)
    per = cells // CHUNK
    for row in twice.toLocalIterator():  # at most HASHES * max_cells / 8 bytes in all
        i, c = divmod(row["chunk"], per)
        bits[i, c * CHUNK // 8 : (c + 1) * CHUNK // 8] = np.frombuffer(row["twice"], np.uint8)
    return bits, cells


def maybe_repeated(spark: SparkSession, bits: np.ndarray, cells: int) -> Callable[[Column, Column], Column]:
    """Second pass: whether the filter leaves open that a digest, given as its two numbers, occurs again."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def look(first: pd.Series, second: pd.Series) -> pd.Series:
        may = np.ones(len(first), bool)
        for row, at in zip(shared.value, _cells(first.to_numpy(), second.to_numpy(), cells)):
            may &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(may)

    return look


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def decide(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """``(uid, doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal if identical; null counts as empty.  Of equal texts the
    row with the largest id stays, and of rows with that same id just one.  A
    null id is smaller than any.  ``uid`` is the row's own number in its
    partition order.  An empty table gives no rows.
    """
    first, second = _halves()
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_column}`").alias("doc_id"), _digest(F.col(f"`{text_column}`")).alias("text_sha256"))
    narrow = stash(narrow.select("*", first.alias("first"), second.alias("second")), "exact-digests")
    bits, cells = repeated_filter(narrow.select("first", "second"), narrow.count(), max_cells)
    look = maybe_repeated(docs.sparkSession, bits, cells)
    marked = narrow.select("uid", "doc_id", "text_sha256", look("first", "second").alias("candidate"))
    open_rows = marked.filter("candidate").drop("candidate")
    groups = open_rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count("*").alias("group_size"))
    groups = stash(groups, "exact-groups")  # so that both sides of the join are dealt anew and a large group can be split
    settled = open_rows.join(groups, "text_sha256").select("uid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")
    alone = marked.filter(~F.col("candidate")).select("uid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(settled)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the choice is that of :func:`decide`.

    Rows whose digest the filter shows once pass straight through, texts and
    all; the others are written once, and each group's best row is joined back
    on the row's own number.
    """
    digest, uid, flag = "__plumbline_digest", "__plumbline_uid", "__plumbline_open"
    first, second = _halves(digest)
    hashed = docs.withColumn(digest, _digest(F.col(f"`{text_column}`")))
    bits, cells = repeated_filter(hashed.select(first.alias("first"), second.alias("second")), docs.count(), max_cells)
    flagged = hashed.withColumn(flag, maybe_repeated(docs.sparkSession, bits, cells)(first, second))
    straight = flagged.filter(~F.col(flag)).drop(digest, flag)
    open_rows = stash(flagged.filter(flag).drop(flag).withColumn(uid, F.monotonically_increasing_id()), "exact-open")
    best = open_rows.groupBy(digest).agg(F.max(F.struct(F.col(f"`{id_column}`").alias("id"), F.col(uid).alias("uid")))["uid"].alias(uid))
    return straight.unionByName(open_rows.join(best.select(uid), uid, "left_semi").drop(digest, uid))
