"""Vector bin packing of token sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing
tokens.  The dot-product heuristic fills one sequence at a time: of the
pieces that fit in all three, the one whose demands point most in the
direction of what is left goes in next.  Documents may be cut, so what is
left of a sequence then is filled with the front of another piece.  Where the
segments or the loss run out first, or a task's tokens do, a sequence ends at
the power of two below, which needs no padding either, and gives back the rest.
Examples that may not be cut are padded.

Documents are all loss.  Instruction data brings the span under the loss, as
chat formatting gives it, and so a third demand of its own.

Packing streams: a task holds a pool of a few hundred pieces of at most one
sequence each, whatever the input's size, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import bytes_of, pick_columns, small_batches


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Piece:
    """A run of one example's tokens that is to lie in one sequence."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None = None  # cumulative loss-bearing tokens, 0 first; None: every token bears loss
    total: int = 0

    def cost(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss[-1] - self.loss[0])

    def fits(self, tokens: int, loss: int) -> int:
        """The longest front within both limits."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(self.loss - self.loss[0], loss, side="right")) - 1)

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        """The first n tokens, and the rest if there is one."""
        if n >= len(self.ids):
            return self, None
        parts = (None, None) if self.loss is None else (self.loss[: n + 1], self.loss[n:])
        return Piece(self.key, self.start, self.ids[:n], parts[0], self.total), Piece(self.key, self.start + n, self.ids[n:], parts[1], self.total)


@dataclass
class VectorPacker:
    """Yields ``(sequence number, [pieces])``; the numbers count up from 0."""

    limits: Limits = Limits()
    pool_size: int = 512
    cuttable: bool = True
    pool: list[Piece] = field(default_factory=list)
    made: int = 0

    def __post_init__(self):
        self._demand = np.empty((3, self.pool_size + 1))
        self._scale = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)

    def _keep(self, piece: Piece) -> None:
        self._demand[:, len(self.pool)] = len(piece.ids), 1, piece.cost()
        self.pool.append(piece)

    def add(self, pieces: Iterable[Piece]) -> Iterator[tuple[int, list[Piece]]]:
        for piece in pieces:
            rest: Piece | None = piece
            while rest is not None:
                if (n := rest.fits(self.limits.tokens, self.limits.loss)) < len(rest.ids) and not self.cuttable:
                    raise ValueError(f"{rest.key!r} exceeds a sequence's limits and may not be cut")
                head, rest = rest.cut(max(n, 1))
                if len(head.ids) == self.limits.tokens:
                    yield self._number(), [head]  # full by itself
                else:
                    self._keep(head)
                while len(self.pool) >= self.pool_size:
                    yield self._number(), self._fill(self.limits.tokens)

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left.  Once it is less than a sequence, one sequence for each power of two in its token count."""
        while self.pool:
            left = sum(len(p.ids) for p in self.pool)
            room = self.limits.tokens if left >= self.limits.tokens or not self.cuttable else 1 << (left.bit_length() - 1)
            yield self._number(), self._fill(min(room, self.limits.tokens))

    def _number(self) -> int:
        self.made += 1
        return self.made - 1

    def _fill(self, room: int) -> list[Piece]:
        """One sequence of at most ``room`` tokens, out of the pool."""
        limits, n = self.limits, len(self.pool)
        demand = self._demand[:, :n]
        tokens, loss = demand[0], demand[2]
        left = [float(room), float(limits.segments), float(limits.loss)]
        free, chosen = np.ones(n, bool), []
        while left[1] >= 1:
            # The dot product of demands and what is left; the segment's part is the same for all pieces.
            along = tokens * (left[0] / self._scale[0] ** 2) + loss * (left[2] / self._scale[2] ** 2)
            along[~(free & (tokens <= left[0]) & (loss <= left[2]))] = -1
            best = int(along.argmax())  # ties: the piece that came first
            if along[best] < 0:
                break
            free[best] = False
            left = [left[0] - tokens[best], left[1] - 1, left[2] - loss[best]]
            chosen.append(self.pool[best])
        if self.cuttable and min(left) > 0 and free.any():
            # Nothing fits whole: the front of the longest piece fills the sequence, or begins an empty one.
            best = int(np.where(free, tokens, -1.0).argmax())
            size = self.pool[best].fits(int(left[0]), int(left[2]))
            if size > 0 and (size == left[0] or not chosen):
                head, rest = self.pool[best].cut(size)
                chosen.append(head)
                if rest is None:
                    free[best] = False
                else:
                    self.pool[best] = rest
                    demand[:, best] = len(rest.ids), 1, rest.cost()
        kept = np.flatnonzero(free)
        self._demand[:, : len(kept)] = demand[:, kept]
        for i in np.flatnonzero(~free)[::-1].tolist():
            del self.pool[i]
        return self._without_padding(chosen) if self.cuttable else chosen

    def _without_padding(self, chosen: list[Piece]) -> list[Piece]:
        """The pieces up to the power of two below, if they aren't a whole sequence; what is behind it goes back to the pool."""
        held = sum(len(p.ids) for p in chosen)
        wanted = held if held == self.limits.tokens else 1 << (held.bit_length() - 1)
        while held > wanted:
            last = chosen.pop()
            held -= len(last.ids)
            if held < wanted:
                head, last = last.cut(wanted - held)
                chosen.append(head)
                held = wanted
            self._keep(last)
        return chosen


#: Sequences of one task are numbered from its partition's number times this.
PER_TASK = 1 << 40


def _packed(rows: DataFrame, keys: list[str], pieces_of: Callable[[pa.RecordBatch], Iterable[Piece]], limits: Limits, pool_size: int, cuttable: bool, with_ids: bool, text_at: int) -> DataFrame:
    """One row for each piece: the keys, ``start, length, loss_tokens, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` if asked for."""
    kinds = dict(rows.dtypes)
    schema = [*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} long" for c in ("start", "length", "loss_tokens", "ids_crc32", "doc_tokens", "sequence_id", "offset")], *["ids array<int>"] * with_ids]
    names = [*keys, "start", "length", "loss_tokens", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits, pool_size, cuttable)
        base = TaskContext.get().partitionId() * PER_TASK
        key_types, out = [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [*key_types, *[pa.int64()] * 7, *[pa.list_(pa.int32())] * with_ids]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def note(sequences: Iterable[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            for number, pieces in sequences:
                at = 0
                for p in pieces:
                    out.append((*p.key, p.start, len(p.ids), p.cost(), zlib.crc32(p.ids.tobytes()), p.total, base + number, at, *[p.ids.view("<i4")] * with_ids))
                    at += len(p.ids)
                if len(out) >= 4096:
                    yield flush()

        for batch in small_batches(batches, text_at):
            key_types = [batch.column(i).type for i in range(len(keys))]
            yield from note(packer.add(pieces_of(batch)))
        yield from note(packer.finish())
        if out:
            yield flush()

    return rows.mapInArrow(run, ", ".join(schema))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits(), pool_size: int = 512, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise, end each document with ``end_id`` and pack into sequences; one row for each piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    ``ids`` if asked for.  Every id, the end's included, lies in exactly one
    piece.  Null and empty texts are the end id alone.  Repeated rows are
    packed each.  Every token of plain documents bears loss.  Sequence numbers
    are unique over the result and the same when a task is run again, since a
    task packs its own rows in order.  Empty tables give no rows; other columns
    are not read.
    """

    def pieces_of(batch: pa.RecordBatch) -> Iterator[Piece]:
        bpe, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for key, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
            ids = np.frombuffer(bpe.encode(text) + end, "<u4")
            yield Piece((key,), 0, ids, None, len(ids))

    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return _packed(rows, ["doc_id"], pieces_of, limits, pool_size, True, with_ids, 1).drop("loss_tokens")


def pack_examples(examples: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits(2048, 64, 1024), pool_size: int = 512, cuttable: bool = True, with_ids: bool = False) -> DataFrame:
    """Pack instruction examples, ``(conv_id, example, formatted, loss_begin, loss_end)`` as chat formatting gives them, under all three limits.

    A row for each piece: ``conv_id, example, start, length, loss_tokens,
    ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for.
    What lies before, in and behind the loss's span (in code points) is
    encoded each on its own, so no token lies across its edges; the end id of
    an example with a loss bears loss too.  Null texts are empty, a null span
    is none.  Examples that may not be cut and exceed a limit are an error.
    Empty tables give no rows; other columns are not read.
    """

    def pieces_of(batch: pa.RecordBatch) -> Iterator[Piece]:
        bpe, end = encoder(path), np.array([end_id], "<u4").tobytes()
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conversation, example, text, a, b in zip(*columns):
            text, a, b = text or "", a or 0, b or 0
            before, own, behind = (bpe.encode(x.encode()) for x in (text[:a], text[a:b], text[max(a, b) :]))
            ids = np.frombuffer(before + own + behind + end, "<u4")
            loss = np.zeros(len(ids) + 1, np.int64)
            loss[1 + len(before) // 4 : 1 + (len(before) + len(own)) // 4] = 1
            loss[-1] = b > a
            yield Piece((conversation, example), 0, ids, np.cumsum(loss), len(ids))

    rows = pick_columns(examples, "conv_id", "example", "formatted", "loss_begin", "loss_end")
    return _packed(rows, ["conv_id", "example"], pieces_of, limits, pool_size, cuttable, with_ids, 2)
