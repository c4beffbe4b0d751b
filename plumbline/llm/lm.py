"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

A log-bilinear model (Mnih and Hinton 2007) predicts a token from the two
before it: the context vectors of these add up, and their inner product with
each token's vector plus its bias is the token's score.  The most frequent
words are tokens of their own; a rarer word is one of some shared tokens, by a
hash of its last bytes, and has there its smoothed share of the shared token's
count, an unseen word being one more type.  So a text's probability is
normalised over all words.

The model is trained by noise-contrastive estimation (Gutmann and Hyvarinen
2010) on every training token: each task goes once over its own documents from
the same beginning, and what tasks have learned is averaged by their tokens
(McDonald et al. 2010), so steps grow with the corpus and the model doesn't.
Batched matrix products then give the normaliser of every context once and for
all, and a token's normalised log-probability takes four look-ups.

What grows with the corpus, the counts of words, stays in tables: the most
frequent words' counts are broadcast (a bounded number), and only tokens
beyond them meet the table in a join.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SUMS, BoundedCache, bytes_of, fold_column, merged_sums, send_sums, small_batches, stash

END = b"\n"  # no word is this
SMOOTH = 0.1
FOLDS, HELD_OUT = 10, 0


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; none depends on the corpus."""

    own: int = 448  # words that are tokens of their own
    shared: int = 64  # tokens that rarer words share by last bytes
    dims: int = 32
    head: int = 1 << 18  # the most words whose counts are broadcast
    noise: int = 64
    batch: int = 2048
    rate: float = 0.01

    @property
    def leaves(self) -> int:
        return self.own + self.shared


def shared_leaf(word: bytes, shape: Shape) -> int:
    return shape.own + xxhash.xxh32_intdigest(word.rstrip(b".,;:!?")[-2:]) % shape.shared


def is_training(doc_id):
    """Rows that the model learns from; those without an id are held out."""
    return F.coalesce(fold_column(doc_id, FOLDS) != HELD_OUT, F.lit(False))


def count_words(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """``(word, c)`` over a column of texts, an end counted for each; a task holds ``most`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, numbers = list(counts), list(counts.values())
            counts.clear()
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.binary()), pa.array(numbers[at : at + (1 << 16)], pa.int64())], names=["word", "c"])

        for batch in small_batches(batches, 0):
            for text in bytes_of(batch.column(0)):
                counts.update(text.lower().split() if text else ())
                if len(counts) >= most:
                    yield from flush()
            counts[END] += batch.num_rows
        yield from flush()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent words: all above the least of some steps that leaves at most ``most``."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}  # at most 8 steps for each bit of a count
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    if least is None:
        return {}
    rows = counts.filter(step >= least).toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["c"].to_pylist()))


class Vocabulary:
    """Places of the head's words, and the model's token (leaf) of every word."""

    def __init__(self, head: dict[bytes, int], shape: Shape):
        self.shape = shape
        words = sorted(head, key=lambda w: (-head[w], w))
        own = words[: shape.own]
        if END not in own:
            own = [*own[: shape.own - 1], END]
        self.own = {w: i for i, w in enumerate(sorted(own))}
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = np.array([head[w] for w in words], float)
        self.leaf = np.array([self.leaf_of(w) for w in words] or [0], np.int16)

    def leaf_of(self, word: bytes) -> int:
        return self.own[word] if word in self.own else shared_leaf(word, self.shape)


class Reader:
    """Words to places in the head and to leaves, with a cache for rarer words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._rare = BoundedCache(vocabulary.leaf_of, 100_000, 64)

    def __call__(self, text: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The rare words of a text and its end, in order; places (-1: rare); leaves; and these after two ends."""
        words = [*(text.lower().split() if text else ()), END]
        at = np.fromiter(map(self.vocabulary.place.get, words, repeat(-1)), np.int32, len(words))
        padded = np.empty(len(words) + 2, np.int16)
        padded[:2] = self.vocabulary.own[END]
        padded[2:] = self.vocabulary.leaf[at]
        rare = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        if rare:
            padded[2:][at < 0] = list(map(self._rare.__getitem__, rare))
        return rare, at, padded[2:], padded


@dataclass
class LogBilinear:
    """Context vectors for each place before a token, token vectors and biases, in one array of ``leaves`` rows."""

    table: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = self.table.shape[1] // 3
        return self.table[:, :d], self.table[:, d : 2 * d], self.table[:, 2 * d : 3 * d], self.table[:, 3 * d]

    def look_ups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logarithms, ``k x k`` each: what the farther and the nearer token before add to a token's score (the bias with the nearer), and the normaliser of each context; batched matrix products."""
        far, near, target, bias = self.parts()
        of_far, of_near = far @ target.T, near @ target.T + bias
        normaliser = np.empty_like(of_far)
        for i in range(len(of_far)):
            scores = of_far[i] + of_near
            top = scores.max(axis=1)
            normaliser[i] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return of_far, of_near, normaliser


def beginning(shares: np.ndarray, shape: Shape, seed: int = 3) -> LogBilinear:
    """Small random vectors, and the shares' logarithms for biases."""
    random = np.random.default_rng(seed).normal(0, 0.1, (shape.leaves, 3 * shape.dims))
    return LogBilinear(np.column_stack([random, np.log(shares)]).astype(np.float32))


class Learner:
    """Noise-contrastive steps with Adam; all tokens of a batch share its noise, so both sides are matrix products.

    What it has learned is the running mean of its parameters, which later steps move less.
    """

    def __init__(self, model: LogBilinear, shares: np.ndarray, shape: Shape, seed: int):
        self.shape, self.rng = shape, np.random.default_rng(seed)
        self.now, self.mean = model.table.astype(np.float32, copy=True), model.table.astype(np.float32, copy=True)
        self._m, self._v, self.steps, self.tokens = np.zeros_like(self.now), np.zeros_like(self.now), 0, 0
        self._ranks, self._log_noise = np.cumsum(shares), np.log(shape.noise * shares).astype(np.float32)

    @staticmethod
    def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        order = rows.argsort(kind="stable")
        ordered = rows[order]
        begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        out[ordered[begins]] += np.add.reduceat(values.take(order, axis=0), begins, axis=0)

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        n, d, k = len(word), self.shape.dims, len(self.now)
        far_p, near_p, target, bias = LogBilinear(self.now).parts()
        noise = np.searchsorted(self._ranks, self.rng.random(self.shape.noise) * self._ranks[-1], side="right").clip(max=k - 1)
        context = far_p.take(far, axis=0) + near_p.take(near, axis=0)
        own, others, shift = target.take(word, axis=0), target[noise], bias - self._log_noise
        with np.errstate(over="ignore"):
            up = np.float32(1 / n) / (1 + np.exp(np.einsum("ij,ij->i", context, own) + shift.take(word)))  # pulls tokens up
            down = np.float32(-1 / n) / (1 + np.exp(-(context @ others.T + shift[noise])))  # pushes noise down
        to_context = up[:, None] * own + down @ others
        gradient = np.zeros_like(self.now)
        self._add(gradient[:, :d], far, to_context)
        self._add(gradient[:, d : 2 * d], near, to_context)
        self._add(gradient[:, 2 * d : 3 * d], word, up[:, None] * context)
        np.add.at(gradient[:, 2 * d : 3 * d], noise, down.T @ context)
        gradient[:, 3 * d] = np.bincount(word, up, k) + np.bincount(noise, down.sum(axis=0), k)
        self.steps += 1
        self.tokens += n
        self._m += np.float32(0.1) * (gradient - self._m)
        self._v += np.float32(0.001) * (gradient * gradient - self._v)
        rate = self.shape.rate / math.sqrt(1 + self.steps / 300) / (1 - 0.9**self.steps)
        self.now += np.float32(rate) * self._m / (np.sqrt(self._v / np.float32(1 - 0.999**self.steps)) + np.float32(1e-8))
        self.mean += np.float32(max(0.01, 1 / (1 + self.steps / 2))) * (self.now - self.mean)


def train(texts: DataFrame, vocabulary: Vocabulary, shares: np.ndarray) -> LogBilinear:
    """One pass over all tokens, each task on its own; the parameters' mean by the tokens that each task has seen."""
    shape = vocabulary.shape
    first = beginning(shares, shape)
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, first, shares))
    width, chunk = first.table.shape[1] + 1, 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model, shares = shared.value
        part = TaskContext.get().partitionId()
        read, learner = Reader(vocabulary), Learner(model, shares, shape, part)
        held: list[np.ndarray] = []
        size = 0

        def learn(least: int) -> None:
            nonlocal held, size
            triples, at = np.concatenate(held, axis=1), 0
            while size - at >= least:
                learner.step(*triples[:, at : at + shape.batch])
                at += min(shape.batch, size - at)
            held, size = [triples[:, at:]], size - at

        for batch in small_batches(batches, 0):
            for text in bytes_of(batch.column(0)):
                padded = read(text)[3]
                held.append(np.stack([padded[:-2], padded[1:-1], padded[2:]]))
                size += len(padded) - 2
                if size >= 16 * shape.batch:
                    learn(shape.batch)
        if size:
            learn(1)
        if learner.tokens:
            yield from send_sums(np.column_stack([learner.mean, np.ones(len(learner.mean))]) * float(learner.tokens), chunk, part)

    total = merged_sums(texts.mapInArrow(run, SUMS), shape.leaves, width, chunk)
    return LogBilinear((total[:, :-1] / total[:, -1:]).astype(np.float32)) if total[0, -1] else first


def leaf_totals(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each leaf."""
    shared, k = counts.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.shape.leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            ids = np.array([shared.value.leaf_of(w) for w in batch.column(0).to_pylist()], np.int64)
            tokens += np.bincount(ids, batch.column(1).to_numpy(), k).astype(np.int64)
            types += np.bincount(ids, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(tokens), pa.array(types)], names=["k", "tokens", "types"])

    tokens, types = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in counts.select("word", "c").mapInArrow(run, "k int, tokens long, types long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect():
        tokens[r["k"]], types[r["k"]] = r["tokens"], r["types"]
    return tokens, types


@dataclass
class Scorer:
    """A text's tokens to the logarithm (base 10) of what the model says, without the rare words' counts."""

    vocabulary: Vocabulary
    of_far: np.ndarray
    of_near: np.ndarray
    normaliser: np.ndarray
    log_share: np.ndarray  # the denominators within the leaves
    log_count: np.ndarray  # of the head's words

    @classmethod
    def of(cls, vocabulary: Vocabulary, model: LogBilinear, tokens: np.ndarray, types: np.ndarray) -> Scorer:
        share = tokens + SMOOTH * np.where(np.arange(len(tokens)) < vocabulary.shape.own, 1, types + 1)
        return cls(vocabulary, *(x / np.float32(math.log(10)) for x in model.look_ups()), np.log10(share), np.log10(vocabulary.counts + SMOOTH))

    def leaves(self, padded: np.ndarray) -> float:
        """The sum of the leaves' normalised log-probabilities, and of the shares' denominators."""
        far, near, own = padded[:-2].astype(np.int32), padded[1:-1].astype(np.int32), padded[2:].astype(np.int32)
        k = len(self.log_share)
        scores = self.of_far.take(far * k + own) + self.of_near.take(near * k + own) - self.normaliser.take(far * k + near)
        return float(scores.sum(dtype=float) - self.log_share.take(own).sum())


def score_documents(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    A null or empty text is one end.  Rows without an id are held out.
    Repeated rows are scored each.  If nothing is there to learn from, all
    words share the unseen word's place.  No rows for an empty table.
    """
    spark = docs.sparkSession
    lowered = docs.select("doc_id", "text")
    learned = lowered.filter(is_training(F.col("doc_id"))).select("text")
    counts = stash(count_words(learned), "lm-counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = size["tokens"], size["types"]
    head = head_words(counts, shape.head)
    vocabulary = Vocabulary(head, shape)
    of_leaf, types_of_leaf = leaf_totals(counts, vocabulary)
    shares = (of_leaf + SMOOTH) / (of_leaf + SMOOTH).sum()
    model = train(learned, vocabulary, shares)
    all_share = math.log10(tokens + SMOOTH * (types + 1))
    shared = spark.sparkContext.broadcast(Scorer.of(vocabulary, model, of_leaf, types_of_leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        read = Reader(scorer.vocabulary)
        for batch in batches:
            n, known, base, score, rare, times = [], [], [], [], [], []
            for text in bytes_of(batch.column(1)):
                beyond, at, own, padded = read(text)
                score.append(scorer.leaves(padded))
                base.append(float(scorer.log_count.take(at[at >= 0]).sum()))
                n.append(len(own))
                known.append(len(own) - len(beyond))
                beyond = Counter(beyond)
                rare.append(list(beyond))
                times.append(list(beyond.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], names=["uid", "n_tokens", "known", "base", "score", "rare", "times"])

    numbered = lowered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    # The id rides along as a column of its own, so that any type of it passes.
    kind = dict(docs.dtypes)["doc_id"]

    def run_with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: deque[pa.Array] = deque()

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, 2):
                ids.append(batch.column(1))
                yield batch.select(["uid", "text"])

        for part in run(texts()):
            yield pa.RecordBatch.from_arrays([*part.columns, ids.popleft()], names=[*part.schema.names, "doc_id"])

    first = stash(numbered.mapInArrow(run_with_id, f"uid long, n_tokens long, known long, base double, score double, rare array<binary>, times array<int>, doc_id {kind}"), "lm-documents")
    rare = first.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    beyond = counts.filter(F.col("c") < min(head.values())) if head else counts
    met = rare.join(beyond, "word", "left").select("uid", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("s"))
    sums = met.groupBy("uid").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    found = first.select("uid", "doc_id", "n_tokens", "known", "base", "score").join(sums, "uid", "left")
    more = F.coalesce("s", F.lit(0.0))
    return found.select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(all_share)).alias("base_score"),
        (F.col("base") + more + F.col("score")).alias("score"),
    )
