"""Quality by random-indexing word vectors and a two-layer network.

Every term has a fixed sparse random index vector; a term's word vector is the
sum of its neighbours' index vectors, up to two places away, over the whole
corpus (Kanerva et al. 2000).  A text is two parallel streams of terms: its
words, and the shapes of its words (runs of small, capital, digit and sign
characters, marked where a word follows itself or a pair of words was there
before).  Word vectors are averaged over each stream, and a network with one
hidden layer, in numpy, turns the pooled vectors into a logit whose
temperature is fitted on training rows kept aside.

Words have hashed places in a table of fixed size, as the vocabulary grows
with the corpus; words that share a place share a vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUMS, BoundedCache, bytes_of, merged_sums, pick_columns, send_sums, small_batches, text_scorer
from .labels import MOST_LABELS, held_out, training_rows

WORDS, SHAPES = 1 << 16, 1 << 13  # places of the two streams
DIMS, ONES, REACH, CHUNK = 32, 4, 2, 1 << 10
HIDDEN = 24
THRESHOLD = 0.7
BLOCK = 1 << 16
_KINDS = bytes(ord("a") if chr(c).islower() or c >= 0x80 else ord("A") if 0x41 <= c <= 0x5A else ord("0") if 0x30 <= c <= 0x39 else c for c in range(256))
_RUN = re.compile(rb"([aA0])\1+")


def word_and_shape(word: bytes) -> int:
    """Places of the word in small letters (upper half) and of its shape."""
    shape = b"a" if word.isalpha() and word.islower() else _RUN.sub(rb"\1", word.translate(_KINDS))
    return (xxhash.xxh64_intdigest(word.lower()) % WORDS) << 32 | xxhash.xxh64_intdigest(b"s" + shape) % SHAPES


class Streams:
    def __init__(self):
        self._known = BoundedCache(word_and_shape, 150_000, 64)

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's words and of their shapes, in order."""
        words = text.split() if text else []
        both = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        own, shape = both >> 32, both & 0xFFFFFFFF
        if len(both) > 1:
            mark = np.zeros(len(both), np.int64)
            pairs = own[:-1] * WORDS + own[1:]
            _, first = np.unique(pairs, return_index=True)
            again = np.ones(len(pairs), bool)
            again[first] = False
            mark[1:][again] = 1
            mark[1:][own[1:] == own[:-1]] = 2
            shape = (shape + mark * 2731) % SHAPES
        return own, shape


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The few places and signs of each term of either stream, words first; the same everywhere."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((WORDS + SHAPES, DIMS)), axis=1)[:, :ONES]
    return places.astype(np.int32), rng.choice(np.array([-1, 1], np.int32), (WORDS + SHAPES, ONES))


def add_neighbours(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """To the row of each term of one text the index vectors of those up to ``REACH`` places away."""
    flat = total.reshape(-1)
    for distance in range(1, REACH + 1):
        left, right = ids[:-distance], ids[distance:]
        for x, y in ((left, right), (right, left)):
            for at in range(0, len(x), BLOCK):
                a, b = x[at : at + BLOCK], y[at : at + BLOCK]
                np.add.at(flat, (a[:, None] * DIMS + places[b]).ravel(), signs[b].ravel())


def word_vectors(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Unit word vectors, ``WORDS + SHAPES`` by ``DIMS``, from all documents.

    What a task sends, and what reaches the driver, has a fixed size whatever
    the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, (places, signs) = _streams(), index_vectors()
        total = np.zeros((WORDS + SHAPES, DIMS), np.int32)
        for batch in small_batches(batches, 0):
            for text in bytes_of(batch.column(0)):
                own, shape = streams(text)
                add_neighbours(total, own, places, signs)
                add_neighbours(total, shape + WORDS, places, signs)
        yield from send_sums(total, CHUNK, TaskContext.get().partitionId())

    out = merged_sums(pick_columns(docs, text_column).mapInArrow(run, SUMS), WORDS + SHAPES, DIMS, CHUNK)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, streams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A text's input: mean vector of each stream and the logarithm of its length."""
    out = np.zeros(2 * DIMS + 1, np.float32)
    for s, ids in enumerate(streams):
        for at in range(0, len(ids), BLOCK):
            out[s * DIMS : (s + 1) * DIMS] += vectors.take(ids[at : at + BLOCK] + s * WORDS, axis=0).sum(axis=0) / np.float32(len(ids))
    out[-1] = np.log1p(len(streams[0])) / 4
    return out


@dataclass
class Network:
    """Two layers over standardised inputs within the training rows' range; probabilities at a fitted temperature."""

    centre: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    high: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((np.clip(x, self.low, self.high) - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What the logits are to be divided by, by the likelihood of the labels; a weak prior holds it near one where rows are few."""
    losses = {t: float(np.sum(np.logaddexp(0, logits / t) - labels * logits / t) + np.log(t) ** 2) for t in np.geomspace(1 / 16, 16, 97)}
    return min(losses, key=losses.get)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.003, seed: int = 5) -> Network:
    """Adam on the logistic loss with nine tenths of the rows, then the temperature on the rest.

    Without rows nothing says that a text is bad: every one gets 0.999.
    """
    d = x.shape[1]
    if not len(x):
        return Network(np.zeros(d), np.ones(d), np.zeros(d), np.zeros(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(999)))
    rng = np.random.default_rng(seed)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log(share / (1 - share))])]
    net = Network(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), x.min(axis=0), x.max(axis=0), *params[:3], float(params[3][0]))
    order = rng.permutation(len(x))
    aside, own = order[: len(order) // 10], order[len(order) // 10 :]
    z = (x - net.centre) / net.spread
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            rows = own[at : at + batch]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            logit = hidden @ params[2] + params[3][0]
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-5 * params[0], back.sum(axis=0), hidden.T @ error + 1e-5 * params[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                params[i] = params[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    net.temperature = fitted_temperature(net.logits(x[aside]), y[aside])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, texts) -> np.ndarray:
        find = _streams()
        return self.network.probabilities(np.array([pool(self.vectors, find(t)) for t in texts]).reshape(-1, 2 * DIMS + 1))


_held: list[Streams] = []


def _streams() -> Streams:
    if not _held:
        _held.append(Streams())
    return _held[0]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_LABELS) -> QualityModel:
    """Word vectors over all documents; the network on at most ``most`` labelled rows outside the held-out fold."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _streams()
        for batch in small_batches(batches, 0):
            x = [pool(shared.value, find(t)) for t in bytes_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([p.tobytes() for p in x], pa.binary())], names=["label", "pooled"])

    rows = training_rows(docs, labels, target, most).select("text", "label").mapInArrow(run, "label int, pooled binary").collect()
    rows = sorted((r["label"], bytes(r["pooled"])) for r in rows)  # an order of their own
    x = np.frombuffer(b"".join(p for _, p in rows), np.float32).reshape(-1, 2 * DIMS + 1).astype(float)
    return QualityModel(vectors, fit(x, np.array([y for y, _ in rows], float)))


def scorer(spark, model: QualityModel):
    """A column function from text to score."""
    shared = spark.sparkContext.broadcast(model)
    return text_scorer(lambda texts: shared.value.score(texts))


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null and empty texts get the score of no words.

    Scores depend on the text alone, so repeated rows score alike.  A null id
    counts as held out.  No rows for an empty table.  Without labelled rows to
    learn from every score is 0.999: nothing says that a text is bad.
    """
    own = docs.select("doc_id", "text")
    score = scorer(docs.sparkSession, train(own, labels, target))
    found = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject.

    Null texts are judged as empty ones, and each row by its own text: of
    repeated rows or equal texts all stay or none.  Without labelled rows to
    learn from all rows stay.  No rows for an empty table.
    """
    score = scorer(docs.sparkSession, train(docs.select("doc_id", "text"), labels, target))
    return docs.withColumn("__plumbline_score", score(F.col("text"))).filter(F.col("__plumbline_score") >= threshold).drop("__plumbline_score")
