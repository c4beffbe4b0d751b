"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import weakref
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, shared_dir, stash  # noqa: F401

#: Words throughout are maximal runs outside these characters, which is what ``bytes.split()`` yields.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that nothing else travels to Python; clashing extra columns stay behind."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list:
    """Texts as UTF-8 bytes; null stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most, one row at least, so that work on a batch stays small.

    When the input ends, so does what the task remembered.
    """
    try:
        for batch in batches:
            begin = held = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
                if held and held + n > most:
                    yield batch.slice(begin, i - begin)
                    begin, held = i, 0
                held += n
            if begin < batch.num_rows:
                yield batch.slice(begin)
    finally:
        forget()


def text_scorer(score: Callable, result: str = "double"):
    """A column function from text to ``score(list of bytes)``; null texts come as None."""
    @F.pandas_udf(result)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in parts:
                out = [score(texts[at : at + 512].tolist()) for at in range(0, len(texts), 512)]
                yield pd.Series(np.concatenate(out) if out else np.empty(0))
        finally:
            forget()

    return lambda text: run(text.cast("binary"))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function on one Arrow batch to what ``mapInArrow`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def fold_of(doc_id: int | None, folds: int) -> int | None:
    """crc32 of the id as decimal text, modulo the number of folds."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def fold_column(col: Column, folds: int) -> Column:
    """:func:`fold_of` as a Spark expression."""
    return F.crc32(col.cast("string").cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bits of one row of a filter of ids, as ``bitmap_construct_agg`` makes them; bits for each id; bits at most (32 MB broadcast).
FILTER_ROW, FILTER_BITS, MOST_BITS = 1 << 15, 16, 1 << 28


def split_by_ids(rows: DataFrame, column: str, ids: DataFrame, most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose whole number ``column`` may be in column ``column`` of ``ids``, and the others, which surely are not there.

    So a join with ``ids`` shuffles few other rows and their texts.  The filter
    has one hash function; beyond ``most`` bits more rows stay open.  Nulls
    are surely not there.  ``ids`` is read twice.
    """
    bits = max(FILTER_ROW, min(most, 1 << (FILTER_BITS * ids.count()).bit_length()))

    def place(of: DataFrame) -> Column:
        return F.pmod(F.xxhash64(of[column].cast("long")), F.lit(bits))

    held = ids.filter(ids[column].isNotNull()).select(place(ids).alias("at"))
    held = held.groupBy(F.floor(F.col("at") / FILTER_ROW).alias("__plumbline_row")).agg(F.bitmap_construct_agg(F.col("at") % FILTER_ROW).alias("__plumbline_bits"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    marked = rows.withColumn("__plumbline_at", place(rows)).withColumn("__plumbline_row", F.floor(F.col("__plumbline_at") / FILTER_ROW)).join(F.broadcast(held), "__plumbline_row", "left")
    at = (F.col("__plumbline_at") % FILTER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__plumbline_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    may = F.col("__plumbline_bits").isNotNull() & F.col(f"`{column}`").isNotNull() & (F.expr("shiftright(__plumbline_byte, __plumbline_bit)").bitwiseAND(F.lit(1)) == 1)
    marked = marked.withColumns({"__plumbline_byte": byte, "__plumbline_bit": (at % 8).cast("int")}).withColumn("__plumbline_may", F.coalesce(may, F.lit(False)))
    return marked.filter("__plumbline_may").select(*names), marked.filter("NOT __plumbline_may").select(*names)


SUMS = "chunk int, part int, at binary, sums binary"
#: Tasks whose sums one merging task adds up at most, in the first of two steps, is the number of tasks by this.
MERGERS = 64


def send_sums(total: np.ndarray, chunk: int, part: int) -> Iterator[pa.RecordBatch]:
    """A task's table of sums as rows of :data:`SUMS`, in single precision: ``chunk`` rows of it at a time, without those that are all zero."""
    for c in range(-(-len(total) // chunk)):
        own = total[c * chunk : (c + 1) * chunk]
        at = np.flatnonzero(own.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part % MERGERS], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([own[at].astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part", "at", "sums"])


def merged_sums(sent: DataFrame, rows: int, columns: int, chunk: int) -> np.ndarray:
    """The sum of what all tasks sent, ``rows`` by ``columns``, on the driver: its size doesn't depend on the number of tasks.

    Sums meet in two steps, by chunk and group of tasks and then by chunk, so no task adds up what all tasks sent.
    """

    def merge(kind: type):
        def run(key: tuple, groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((chunk, columns))
            for group in groups:
                for at, sums in zip(group["at"], group["sums"]):
                    total[np.frombuffer(at, np.int32)] += np.frombuffer(sums, kind).reshape(-1, columns)
            yield pd.DataFrame({"chunk": [key[0]], "part": [0], "at": [np.arange(chunk, dtype=np.int32).tobytes()], "sums": [total.tobytes()]})

        return run

    out = np.zeros((-(-rows // chunk) * chunk, columns))
    for row in sent.groupBy("chunk", "part").applyInPandas(merge(np.float32), SUMS).groupBy("chunk").applyInPandas(merge(np.float64), SUMS).collect():
        out[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["sums"], np.float64).reshape(chunk, columns)
    return out[:rows]


_caches: list[weakref.ref] = []


def forget() -> None:
    """Cut all caches of this Python process to what a next task is likely to ask for.

    Workers outlive their tasks, and several may lie idle in an executor, so
    little may stay with them.  Frequent keys come early in any text: the
    entries that came first are kept.
    """
    for cache in [c for r in _caches if (c := r()) is not None]:
        kept = dict(islice(cache.items(), cache.limit // 12))
        cache.clear()
        cache.update(kept)
        cache.old = {}
    _caches[:] = [r for r in _caches if r() is not None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # give free memory back to the system, where the C library can
    except (OSError, AttributeError):
        pass


class BoundedCache(dict):
    """A dictionary that computes what it lacks and holds at most twice ``limit`` entries.

    There are two generations: at ``limit`` entries the young one becomes the
    old one, and what is asked for again comes back from there.  So what is
    frequent stays, and rare keys leave.
    """

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 200):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
