"""Repeated passages by sparse suffix arrays.

Of all suffixes (by words) only those at content-selected minimiser positions
are kept: in every window of ``least`` words the ``key`` consecutive words of
least hash are selected, leftmost on a tie, so two equal windows select the
same place in them.  The kept suffixes are sorted by their first ``key`` words
over the whole corpus and neighbours are compared; a suffix without an equal
neighbour can lie in no repeated window it stands for and goes.

The others are sorted lexicographically: by those words, by the words to the
right of them, then by the words to the left, nearest first.  Neighbours are
compared for the length they have in common to the right and to the left, so
matches are extended both ways: a window that reaches so far to the left and so
far to the right of its selected place is repeated if a suffix agrees that far
on both sides.  Suffixes that agree to the right stand together; where their
left sides differ they are sorted by these, and neighbours are compared again.
Windows that touch are one passage.  That finds exactly the words that lie in a
run of ``least`` words standing at two places of the corpus or more.

Sorts range-partition on all their columns, down to document and place, so
however often a passage occurs its occurrences are spread over tasks, and only
neighbours are ever compared: no large group is gathered, no pairs are formed.
A group of few suffixes stays in one task, which settles it; large groups, of
which a task sees only a part, are settled by a sort of their windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, bytes_of, mix64, small_batches, split_by_ids, stash

#: Suffixes that a task extends at a time.
BLOCK = 1 << 16
#: Suffixes of one key that stay in one task; more are spread over tasks.
WHOLE = 1 << 12
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
SECOND = 0xC2B2AE3D27D4EB4F | 1


class WordHashes:
    """64-bit hashes of a text's words, and of all its runs of n words."""

    def __init__(self):
        self._hash = BoundedCache(xxhash.xxh64_intdigest, 300_000, 64)

    def words(self, text: bytes | None) -> np.ndarray:
        found = text.split() if text else []
        return np.fromiter(map(self._hash.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def runs(words: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
        """The hash of each run of n words, from sums of powers modulo 2^64, mixed."""
        if len(words) < n:
            return np.empty(0, np.uint64)
        powers = np.ones(len(words), np.uint64)
        powers[1:] = np.uint64(base)
        powers = np.multiply.accumulate(powers)
        inverse = np.ones(len(words), np.uint64)
        inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers, out=sums[1:])
        return mix64((sums[n:] - sums[:-n]) * inverse[: len(words) - n + 1])


def minimisers(words: np.ndarray, least: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected places, the hash of the ``key`` words there, and for each window of ``least`` words its selected place."""
    hashes, width = WordHashes.runs(words, key), least - key + 1
    if len(hashes) < width:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none
    chosen = np.empty(len(hashes) - width + 1, np.int64)
    step = 1 << 15
    for at in range(0, len(chosen), step):  # a bounded view at a time for very long texts
        part = np.lib.stride_tricks.sliding_window_view(hashes[at : at + step + width - 1], width)
        chosen[at : at + step] = part.argmin(axis=1) + np.arange(at, at + len(part))
    places = np.unique(chosen)
    return places, hashes[places], chosen


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def compare_neighbours(rows: DataFrame, partitions: int) -> DataFrame:
    """Sort ``(a, b, doc, place)`` by all four and compare neighbours on ``(a, b)``.

    Gives ``(doc, place, again, first)`` of each row with an equal neighbour:
    ``first`` says it is the first of its run.  A run may go on in the next
    partition, so a partition also reports its ends, and the two rows there are
    settled by those reports: two rows a partition, joined on their key.
    """
    ordered = rows.repartitionByRange(partitions, "a", "b", "doc", "place").sortWithinPartitions("a", "b", "doc", "place")
    names = ["a", "b", "doc", "place", "first", "state", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, begun = TaskContext.get().partitionId(), None, False

        def emit(a, b, doc, place, first, state):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(doc), pa.array(place), pa.array(first), pa.array(np.full(n, state, np.int32)), pa.array(np.full(n, part, np.int32))], names=names)

        # state 0: settled and repeated; 1: the partition's first row; 2: its last row; 3: its only row
        pending = None  # the last row seen: (columns, equals the one before, is the partition's first)
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            if pending is not None:
                columns = [np.concatenate([p, c]) for p, c in zip(pending[0], columns)]
            a, b, doc, place = columns
            before = np.zeros(len(a), bool)
            before[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            opening = np.zeros(len(a), bool)
            if pending is None:
                opening[0] = True
            else:
                before[0], opening[0] = pending[1], pending[2]
            now = slice(0, len(a) - 1)  # the last row waits for what follows
            after = before[1:]
            again = (before[now] | after) & ~opening[now]
            if again.any():
                yield emit(a[now][again], b[now][again], doc[now][again], place[now][again], ~before[now][again], 0)
            if opening[now].any():
                at = np.flatnonzero(opening[now])
                yield emit(a[at], b[at], doc[at], place[at], after[at], 1)  # here `first` tells whether the next row is equal
            pending = ([c[-1:] for c in columns], bool(before[-1]), bool(opening[-1]))
        if pending is not None:
            (a, b, doc, place), before, opening = pending
            yield emit(a, b, doc, place, np.array([before]), 3 if opening else 2)  # here it tells whether the row before is equal

    found = stash(ordered.mapInArrow(run, "a long, b long, doc long, place int, first boolean, state int, part int"), "suffix-neighbours")
    ends = found.filter("state > 0")
    # What other partitions hold of the same key: the first that ends with it, and the last that begins with it.
    met = ends.groupBy("a", "b").agg(F.min(F.expr("CASE WHEN state <> 1 THEN part END")).alias("closed"), F.max(F.expr("CASE WHEN state <> 2 THEN part END")).alias("opened"))
    settled = ends.join(met, ["a", "b"]).select("doc", "place", "state", "first", F.coalesce(F.col("closed") < F.col("part"), F.lit(False)).alias("earlier"), F.coalesce(F.col("opened") > F.col("part"), F.lit(False)).alias("later"))
    # An opening row looks back to earlier partitions; a closing row is later than its equals in its own.
    judged = settled.select("doc", "place", F.expr("CASE state WHEN 1 THEN earlier OR first WHEN 2 THEN first OR later ELSE earlier OR later END").alias("again"), F.expr("CASE state WHEN 2 THEN NOT first ELSE NOT earlier END").alias("first"))
    return found.filter("state = 0").select("doc", "place", "first").unionByName(judged.filter("again").select("doc", "place", "first"))


def sampled_suffixes(numbered: DataFrame, least: int, key: int) -> DataFrame:
    """``(a, b, doc, place)`` of every selected suffix of ``(doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in small_batches(batches, 1):
            keys, docs, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                at, hashes, _ = minimisers(hasher.words(text), least, key)
                keys.append(hashes)
                places.append(at)
                docs.append(np.full(len(at), doc, np.int64))
            if keys:
                place = np.concatenate(places).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.zeros(len(place), np.int64)), pa.array(np.concatenate(docs)), pa.array(place)], names=["a", "b", "doc", "place"])

    return numbered.select("doc", "text").mapInArrow(run, "a long, b long, doc long, place int")


def contexts(with_places: DataFrame, least: int, key: int) -> DataFrame:
    """``(a, right, left, doc, place, low, high)`` of each surviving suffix of ``(doc, text, places)``.

    ``a`` is the hash of its ``key`` words; ``right`` has 16 bits of each of
    the ``least - key`` words behind them, ``left`` of those before, nearest
    first; the windows it stands for begin ``low`` to ``high`` words before it.
    """
    reach = least - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in small_batches(batches, 1):
            keys, right, left, docs, places, lows, highs = [], [], [], [], [], [], []
            for doc, text, alive in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2)):
                words = hasher.words(text)
                selected, hashes, chosen = minimisers(words, least, key)
                at = np.sort(alive.values.to_numpy()).astype(np.int64)
                codes = np.zeros(len(words) + 2 * reach, np.uint16)
                codes[reach : reach + len(words)] = words >> np.uint64(48)
                spans = np.lib.stride_tricks.sliding_window_view(codes, reach) if reach else np.zeros((len(codes) + 1, 0), np.uint16)
                keys.append(hashes[np.searchsorted(selected, at)])
                right.append(spans[at + reach + key])
                left.append(spans[at][:, ::-1])
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at)
                highs.append(at - np.searchsorted(chosen, at))
                lows.append(at - np.searchsorted(chosen, at, side="right") + 1)
            if keys:
                binary = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * reach), sum(map(len, x)), [None, pa.py_buffer(np.ascontiguousarray(np.concatenate(x)))]).cast(pa.binary()) for x in (right, left)]
                ints = [pa.array(np.concatenate(x).astype(np.int32)) for x in (places, lows, highs)]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), *binary, pa.array(np.concatenate(docs)), *ints], names=["a", "right", "left", "doc", "place", "low", "high"])

    return with_places.select("doc", "text", "places").mapInArrow(run, "a long, right binary, left binary, doc long, place int, low int, high int")


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many entries the rows of two tables have in common from the first on."""
    unlike = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return unlike.argmax(axis=1)


@dataclass
class Suffixes:
    """Some suffixes in their order, with the words around them."""

    a: np.ndarray
    right: np.ndarray
    left: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    large: np.ndarray  # whether other tasks may have suffixes of this key

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Suffixes:
        codes = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (1, 2)]
        return cls(batch.column(0).to_numpy(), *codes, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8)))

    def columns(self) -> list[np.ndarray]:
        return [self.a, self.right, self.left, self.doc, self.place, self.low, self.high, self.large]

    def __len__(self) -> int:
        return len(self.a)

    def __getitem__(self, at) -> Suffixes:
        return Suffixes(*(c[at] for c in self.columns()))

    def and_then(self, other: Suffixes) -> Suffixes:
        return Suffixes(*map(np.concatenate, zip(self.columns(), other.columns())))

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix a bit for each number of words before it: whether the window that begins there is repeated, and whether it stands here first.

        Of a group (of one ``a``) that isn't wholly here this holds among those
        that are.
        """
        n, reach = len(self), self.right.shape[1]
        again, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n < 2:
            return again, first
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.place, self.doc))] = np.arange(n)
        to_right = np.append(np.where(self.a[1:] == self.a[:-1], common(self.right[1:], self.right[:-1]), -1), -1)
        by_left = None

        def mark(rows: np.ndarray, like: np.ndarray, bit: int) -> None:
            """``like``: whether a row's window equals the one of the row before."""
            begins = np.flatnonzero(np.r_[True, ~like])
            sizes = np.diff([*begins, len(rows)])
            many = np.repeat(sizes, sizes) > 1
            earliest = np.repeat(np.minimum.reduceat(rank[rows], begins), sizes)
            again[rows[many]] |= 1 << bit
            first[rows[many & (rank[rows] == earliest)]] |= 1 << bit

        for before in range(reach + 1):
            rows = np.flatnonzero((self.low <= before) & (before <= self.high))
            if len(rows) < 2:
                continue
            together = np.minimum.reduceat(to_right, rows)[:-1] >= reach - before
            like = together & (self.left[rows[1:], :before] == self.left[rows[:-1], :before]).all(axis=1)
            run = np.r_[0, np.cumsum(~together)]
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[1:][together & ~like]] = True
            some = mixed[run]
            whole = np.flatnonzero(~some)
            if len(whole):
                mark(rows[whole], (np.diff(whole) == 1) & like[whole[1:] - 1], before)
            if some.any():
                # An order of the left sides, by a hash of their words; what counts is the words.
                if by_left is None:
                    by_left = np.cumsum(mix64(self.left.astype(np.uint64) + (np.arange(1, reach + 1, dtype=np.uint64) << np.uint64(32))), axis=1)
                own, of = rows[some], run[some]
                order = np.lexsort((by_left[own, before - 1], of))
                own, of = own[order], of[order]
                mark(own, (of[1:] == of[:-1]) & (self.left[own[1:], :before] == self.left[own[:-1], :before]).all(axis=1), before)
        return again, first

    def undecided(self, again: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of a part of a group, by what :meth:`extended` says of it: bits of the windows that the rest of the group may change.

        Of equal windows only the one first here may be preceded elsewhere.  A
        window without its like here has none elsewhere either if neither
        neighbour agrees far enough to the right, as neighbours agree longest;
        the part's own ends have neighbours elsewhere.
        """
        n, reach = len(self), self.right.shape[1]
        every = ((np.int64(1) << (self.high.astype(np.int64) + 1)) - 1) & ~((np.int64(1) << self.low.astype(np.int64)) - 1)
        shared = np.where(self.a[1:] == self.a[:-1], common(self.right[1:], self.right[:-1]), reach)
        longest = np.maximum(np.r_[reach, shared], np.r_[shared, reach]) if n else np.empty(0, np.int64)
        return first | every & ~again & ~((np.int64(1) << (reach - longest)) - 1)

    def windows(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the windows at these bits, with document and place."""
        reach = self.right.shape[1]
        out: list[list[np.ndarray]] = [[], [], [], []]
        sums = []
        for base in (BASE, SECOND):
            steps = np.arange(1, reach + 1, dtype=np.uint64) * np.uint64(base)
            for codes, side in ((self.left, 1), (self.right, 2)):
                each = mix64(codes.astype(np.uint64) + (steps << np.uint64(16)) + np.uint64(side << 62))
                sums.append(np.concatenate([np.zeros((len(self), 1), np.uint64), np.cumsum(each, axis=1)], axis=1))
        for before in range(reach + 1):
            rows = np.flatnonzero(bits >> before & 1)
            key = self.a[rows].view(np.uint64)
            for i, base in enumerate((BASE, SECOND)):
                out[i].append(mix64(key * np.uint64(base) + sums[2 * i][rows, before] + mix64(sums[2 * i + 1][rows, reach - before])))
            out[2].append(self.doc[rows])
            out[3].append((self.place[rows] - before).astype(np.int32))
        return _signed(np.concatenate(out[0])), _signed(np.concatenate(out[1])), np.concatenate(out[2]), np.concatenate(out[3])


SETTLED = "a long, b long, doc long, place int, places array<int>, again array<int>, first array<int>"


def extend(rows: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Sort the suffixes of :func:`contexts` and extend matches.

    ``(doc, places, again, first)`` of those with a repeated window, as lists of
    places and of bits by the words before them: a row for each document of a
    block, however many of its suffixes are there; and ``(a, b, doc, place)`` of windows of groups that
    lie in several tasks or blocks, as far as other parts of the group may
    change what was found among the suffixes of one.
    """
    columns = ["a", "right", "left", "doc", "place"]
    # At most one in WHOLE of the keys, with nothing but the key.
    large = rows.groupBy("a").count().filter(F.col("count") > WHOLE).select("a", F.lit(True).alias("large"))
    marked = rows.join(F.broadcast(large), "a", "left").select(*rows.columns, F.coalesce("large", F.lit(False)).alias("large"))
    dealt = marked.repartitionByRange(partitions, "a", *[F.when(F.col("large"), F.col(c)) for c in columns[1:]])
    ordered = dealt.sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = None, None

        def settle(some: Suffixes, last_is_open: bool) -> Iterator[pa.RecordBatch]:
            is_open = some.large | (some.a == open_key)
            if last_is_open:
                is_open |= some.a == some.a[-1]
            again, first = some.extended()
            at = np.flatnonzero(again)
            if len(at):
                at = at[np.argsort(some.doc[at], kind="stable")]
                docs, begins = np.unique(some.doc[at], return_index=True)
                bounds = pa.array(np.r_[begins, len(at)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x[at].astype(np.int32))) for x in (some.place, again, first)]
                nothing = pa.nulls(len(docs), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(docs), pa.nulls(len(docs), pa.int32()), *lists], names=names)
            rest, bits = some[is_open], some[is_open].undecided(again[is_open], first[is_open])
            for at in range(0, len(rest), BLOCK // 4):
                a, b, doc, place = rest[at : at + BLOCK // 4].windows(bits[at : at + BLOCK // 4])
                none = pa.nulls(len(a), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(doc), pa.array(place), none, none, none], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = Suffixes.of(batch)
            held = new if held is None else held.and_then(new)
            if len(held) >= BLOCK:
                cut = int(np.flatnonzero(held.a != held.a[-1])[-1]) + 1 if held.a[0] != held.a[-1] else len(held)
                yield from settle(held[:cut], cut == len(held))
                if cut == len(held):
                    open_key = held.a[-1]
                held = held[cut:]
        if held is not None and len(held):
            yield from settle(held, False)

    names = [c.split()[0] for c in SETTLED.split(", ")]
    found = stash(ordered.mapInArrow(run, SETTLED), "suffix-extended")
    return found.filter("a is null").select("doc", "places", "again", "first"), found.filter("a is not null").select("a", "b", "doc", "place")


def _stretches(places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the unions of windows that begin at sorted places."""
    breaks = np.flatnonzero(places[1:] > places[:-1] + least)
    return places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]] + least


def _spans(found: DataFrame, least: int) -> DataFrame:
    """Repeated windows, ``(doc, places, again, first)`` by lists of bits, to one row a document: its passages and the parts of them that repeat something earlier.

    A window that is there twice is first only if both say so.
    """
    rows = found.groupBy("doc").agg(F.collect_list(F.struct("places", "again", "first")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for windows in batch.column(1):
                place, again, first = (windows.values.field(c).flatten().to_numpy().astype(np.int64) for c in ("places", "again", "first"))
                at, before = np.nonzero(again[:, None] >> np.arange(32) & 1)
                begins = place[at] - before
                later = np.unique(begins[(first[at] >> before & 1) == 0])
                begin, end = _stretches(np.unique(begins), least)
                cut_begin, cut_end = _stretches(later, least) if len(later) else (later, later)
                for held, x in zip(out, (begin, end, cut_begin, cut_end)):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int64())) for x in out]], names=["doc", "begins", "ends", "cut_begins", "cut_ends"])

    return rows.mapInArrow(run, "doc long, begins array<long>, ends array<long>, cut_begins array<long>, cut_ends array<long>")


def repeated_spans(numbered: DataFrame, least: int = 50, key: int = 20, partitions: int | None = None) -> DataFrame:
    """``(doc, begins, ends, cut_begins, cut_ends)`` for documents of ``(doc, text)`` with a repeated passage.

    ``doc`` must be a unique long.  Spans are in words, ends exclusive; the cut
    spans are what remains to take away so that of equal windows only the one
    first in (doc, place) order stays.  Null texts, empty ones and those of
    fewer than ``least`` words have no row; equal texts repeat each other from
    end to end.  No rows for an empty table.
    """
    if not 1 <= key <= least <= key + 30:
        raise ValueError("a window has the key's words and at most 30 more")
    n = partitions or max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    suffixes = stash(sampled_suffixes(numbered, least, key), "suffix-sample")
    alive = stash(compare_neighbours(suffixes, n).groupBy("doc").agg(F.collect_list("place").alias("places")), "suffix-alive")
    perhaps, _ = split_by_ids(numbered, "doc", alive)
    around = stash(contexts(perhaps.join(alive, "doc"), least, key), "suffix-contexts")
    settled, rest = extend(around, n)
    others = compare_neighbours(rest, n).select("doc", F.array("place").alias("places"), F.array(F.lit(1)).alias("again"), F.array(F.col("first").cast("int")).alias("first"))
    return _spans(settled.unionByName(others), least)


def numbered_rows(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """``(doc, text)`` under the documents' own ids where these are unique and there, else under row numbers; and the rows with that number.

    The check reads ids alone.
    """
    ids = F.col(f"`{id_column}`")
    whole = dict(docs.dtypes)[id_column] in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.filter(ids.isNull()).isEmpty() and docs.groupBy(ids).count().filter("count > 1").isEmpty():
        rows = docs.withColumn("__plumbline_doc", ids.cast("long"))
    else:
        rows = stash(docs.withColumn("__plumbline_doc", F.monotonically_increasing_id()), "suffix-input")
    return rows.select(F.col("__plumbline_doc").alias("doc"), F.col(f"`{text_column}`").alias("text")), rows


def repeated_passages(docs: DataFrame, least: int = 50, key: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, begin, n_words, n_cut)``: each passage that occurs elsewhere too, by place of its first word.

    ``n_cut`` of its words repeat an earlier window and go in deduplication.
    Null and empty texts and those of fewer than ``least`` words have none.  A
    repeated row is a copy like any other: its whole text is a passage.
    """
    numbered, rows = numbered_rows(docs, id_column, text_column)
    spans = repeated_spans(numbered, least, key).select("doc", F.explode(F.arrays_zip("begins", "ends")).alias("x"), F.arrays_zip("cut_begins", "cut_ends").alias("cuts"))
    cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + F.greatest(F.lit(0).cast("long"), F.least(c["cut_ends"], F.col("x.ends")) - F.greatest(c["cut_begins"], F.col("x.begins"))))
    found = spans.select("doc", F.col("x.begins").alias("begin"), (F.col("x.ends") - F.col("x.begins")).alias("n_words"), cut.alias("n_cut"))
    ids = rows.select(F.col("__plumbline_doc").alias("doc"), F.col(f"`{id_column}`").alias("doc_id"))
    return found.join(ids, "doc").select("doc_id", "begin", "n_words", "n_cut")


def cut_text(text: bytes, begins: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and the white space before each of them."""
    import re

    places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for begin, end in zip(begins, ends):
        out.append(text[at : places[begin - 1][1] if begin else 0])
        at = places[end - 1][1]
    out.append(text[at:])
    return b"".join(out)


def deduplicate(docs: DataFrame, least: int = 50, key: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each repeated window left at its first place only, by id.

    Documents without repeats stay as they are, null and empty texts among
    them; a document of which no word is left goes, so of equal texts of
    ``least`` words or more, and of repeated rows, one stays.  Rows count by
    their place in the table where an id is null or repeated.  ``n_chars``
    follows the text where there is such a column.  No rows for an empty table.
    """
    numbered, rows = numbered_rows(docs, id_column, text_column)
    spans = repeated_spans(numbered, least, key).filter(F.size("cut_begins") > 0).select(F.col("doc").alias("__plumbline_doc"), F.col("cut_begins").alias("__plumbline_from"), F.col("cut_ends").alias("__plumbline_to"))
    spans = stash(spans, "suffix-cuts")

    @F.pandas_udf("string")
    def shorten(texts, begins, ends):
        import pandas as pd

        return pd.Series([cut_text(t.encode(), b, e).decode() if b is not None else t for t, b, e in zip(texts, begins, ends)], dtype=object)

    # Only texts that are cut, and few others, are shuffled.
    perhaps, straight = split_by_ids(rows, "__plumbline_doc", spans)
    joined = stash(perhaps.join(spans, "__plumbline_doc", "left"), "suffix-joined")
    whole = joined.filter("__plumbline_from is null").select(*[F.col(f"`{c}`") for c in docs.columns])
    cut = joined.filter("__plumbline_from is not null").withColumn(text_column, shorten(F.col(f"`{text_column}`"), "__plumbline_from", "__plumbline_to"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(F.col(f"`{text_column}`")).cast(dict(docs.dtypes)["n_chars"]))
    cut = cut.filter(F.translate(F.col(f"`{text_column}`"), " \t\n\x0b\x0c\r", "") != "").select(*[F.col(f"`{c}`") for c in docs.columns])
    return straight.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(whole).unionByName(cut)


def oracle(least: int = 50, table: str = "documents") -> str:
    """The rows of :func:`repeated_passages` in DuckDB's SQL, from all windows; ids must be unique."""
    return f"""
    WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    windows AS (
      SELECT doc_id, i, md5_number(array_to_string(w[i + 1 : i + {least}], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - {least})) AS i FROM words WHERE len(w) >= {least})),
    again AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
    marked AS (SELECT *, sum(CASE WHEN gap <= {least} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS stretch
               FROM (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM again)),
    passages AS (SELECT doc_id, stretch, min(i) AS begin, max(i) + {least} - min(i) AS n_words FROM marked GROUP BY ALL),
    cuts AS (SELECT doc_id, stretch, sum(least(coalesce(nxt - i, {least}), {least})) AS n
             FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, stretch ORDER BY i) AS nxt FROM marked WHERE later) GROUP BY ALL)
    SELECT doc_id, begin::BIGINT AS begin, n_words::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_cut
    FROM passages LEFT JOIN cuts USING (doc_id, stretch)"""
