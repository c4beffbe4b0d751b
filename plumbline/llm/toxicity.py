"""Toxicity by a factorisation machine over hashed terms.

Terms are a text's words without punctuation around them and their beginnings
of four to six bytes, hashed.  A second-order factorisation machine (Rendle
2010) learns a weight for each admitted term and, by inner products of
factors, one for each pair of them, which catches what single weights miss: an
insult that is banter alone, a group that is mentioned harmlessly, and both in
one text.

So what a term says alone must not decide on its place in the machine.
Admitted are terms that tell the labels apart beyond chance, terms in one of
ten training rows or more whatever they tell, and terms that tell the labels
apart among the rows with one of the most telling terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, bytes_of, per_batch, small_batches, stash, text_scorer
from .labels import MOST_LABELS, held_out, training_rows

BUCKETS = 1 << 18
FACTORS = 8
LEAST_GAIN = 10.83  # chi-squared, one degree of freedom, one in a thousand
LEAST_PAIR_GAIN = 28.37  # one in ten millions, as there are as many pairs
LEAST_SHARE = 0.1
PARTNERS = 16  # the terms of greatest gain, among whose rows pairs are looked for
AROUND = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
THRESHOLD = 0.3


def word_terms(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    bare = word.strip(AROUND)
    if not bare:
        return ()
    parts = [b"w" + bare, *[b"p" + bare[:n] for n in (4, 5, 6) if len(bare) >= n]]
    return tuple(xxhash.xxh64_intdigest(p) % BUCKETS for p in parts)


class Terms:
    """A text's distinct terms, or the places of the admitted ones among ``slots``, sorted; null and empty texts have none."""

    def __init__(self, slots: np.ndarray | None = None):
        self._place = None if slots is None else {b: i for i, b in enumerate(slots.tolist())}
        self._known = BoundedCache(self._of_word, 200_000, 64)

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        found = word_terms(word)
        return found if self._place is None else tuple([self._place[b] for b in found if b in self._place])

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = set(text.lower().split()) if text else ()
        return np.array(sorted(set().union(*map(self._known.__getitem__, words))), np.int32)


def laid_out(rows: list[np.ndarray], last: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' places one after the other, each row ended by ``last``, and where each begins."""
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    begins = np.cumsum(sizes) - sizes
    index = np.full(int(sizes.sum()), last, np.int32)
    index[np.delete(np.arange(len(index)), begins + sizes - 1)] = np.concatenate([*rows, np.empty(0, np.int32)])
    return index, begins


@dataclass
class FactorisationMachine:
    """``sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)`` over the admitted terms of a text.

    A row of ``params`` is ``w_i, v_i``; the last one is ``w0`` with no factors, a term of every text.
    """

    slots: np.ndarray  # the admitted buckets, sorted
    params: np.ndarray

    def raw(self, index: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logits, the terms' parameters and their sums by row."""
        own = self.params.take(index, axis=0)
        sums = np.add.reduceat(own, begins, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", own[:, 1:], own[:, 1:]), begins)
        return sums[:, 0] + 0.5 * (np.einsum("ij,ij->i", sums[:, 1:], sums[:, 1:]) - squares), own, sums

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of sorted places among the slots."""
        if not rows:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*laid_out(rows, len(self.slots)))[0].astype(float), -40, 40)))


def gain(ones: Column, seen: Column, all_ones: Column, everything: Column) -> Column:
    """The likelihood-ratio statistic of a term's presence against the label, by counts; zero if all labels are the same."""

    def part(x: Column, total: Column, share: Column) -> Column:
        return F.when(x > 0, x * F.log(x / (total * share))).otherwise(0.0)

    share, unseen = all_ones / everything, everything - seen
    other = 1 - share
    parts = part(ones, seen, share) + part(seen - ones, seen, other) + part(all_ones - ones, unseen, share) + part(unseen - all_ones + ones, unseen, other)
    return F.when((all_ones > 0) & (all_ones < everything), 2 * parts).otherwise(0.0)


def fit(slots: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 1e-2, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss; the same numbers on every run.  Without rows every text gets one in a thousand."""
    rng, m = np.random.default_rng(seed), len(slots)
    params = np.zeros((m + 1, FACTORS + 1), np.float32)
    params[:m, 1:] = rng.normal(0, 0.02, (m, FACTORS))
    model = FactorisationMachine(slots, params)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(rows) else 1e-3
    params[m, 0] = np.log(share / (1 - share))
    if not len(rows):
        return model
    order, batches = rng.permutation(len(rows)), []
    for at in range(0, len(order), batch):
        chosen = order[at : at + batch]
        index, begins = laid_out([rows[i] for i in chosen], m)
        owner = np.repeat(np.arange(len(chosen)), np.diff([*begins, len(index)]))
        by_term = index.argsort(kind="stable").astype(np.int32)
        ordered = index[by_term]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        batches.append((index, begins, owner.astype(np.int32), labels[chosen], by_term, first, ordered[first]))
    mean, square, step = np.zeros_like(params), np.zeros_like(params), 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)).tolist():
            index, begins, owner, want, by_term, first, touched = batches[b]
            logit, own, sums = model.raw(index, begins)
            error = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - want) / len(want)).astype(np.float32)
            each = sums.take(owner, axis=0) - own
            each[:, 0] = 1
            each *= error.take(owner)[:, None]
            gradient = params * np.float32(decay * len(want) / len(rows))
            gradient[touched] += np.add.reduceat(each.take(by_term, axis=0), first, axis=0)
            gradient[m, 1:] = 0
            step += 1
            mean += np.float32(0.1) * (gradient - mean)
            square += np.float32(0.001) * (gradient * gradient - square)
            params -= np.float32(rate / (1 - 0.9**step)) * mean / (np.sqrt(square / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return model


def admitted(rows: DataFrame) -> np.ndarray:
    """The buckets that enter the machine, by counts over ``(label, terms)``; the driver gets these alone."""
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), F.count("*").alias("n")).first()
    ones, n = F.lit(float(total["ones"])), F.lit(float(total["n"]))
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("ones"), F.count("*").alias("seen"))
    counted = stash(counted.withColumn("gain", gain(F.col("ones"), F.col("seen"), ones, n)), "toxicity-gains")
    telling = counted.filter(F.col("gain") >= LEAST_GAIN)
    best = [r["term"] for r in telling.orderBy(F.desc("gain"), "term").limit(PARTNERS).collect()]
    found = telling.select("term").unionByName(counted.filter(F.col("seen") >= LEAST_SHARE * n).select("term"))
    if best:
        within = rows.select("label", "terms", F.explode(F.array_intersect("terms", F.array(*map(F.lit, best)))).alias("partner"))
        sizes = within.groupBy("partner").agg(F.sum("label").alias("all_ones"), F.count("*").alias("everything"))
        pairs = within.select("label", "partner", F.explode("terms").alias("term")).groupBy("partner", "term").agg(F.sum("label").alias("ones"), F.count("*").alias("seen"))
        pairs = pairs.join(F.broadcast(sizes), "partner")  # at most PARTNERS rows
        found = found.unionByName(pairs.filter(gain(F.col("ones"), F.col("seen"), F.col("all_ones"), F.col("everything")) >= LEAST_PAIR_GAIN).select("term"))
    return np.sort(np.array([r["term"] for r in found.distinct().collect()], np.int32))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MOST_LABELS) -> FactorisationMachine:
    """Fit on at most ``most`` labelled rows outside the held-out fold, of which the driver gets the admitted terms.

    Without labelled rows the model knows no terms and calls no text toxic.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Terms()
        for batch in small_batches(batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([find(t) for t in bytes_of(batch.column(0))], pa.list_(pa.int32()))], names=["label", "terms"])

    rows = stash(training_rows(docs, labels, target, most).select("text", "label").mapInArrow(terms, "label int, terms array<int>"), "toxicity-terms")
    slots = admitted(rows)

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        at = np.searchsorted(slots, values)
        hit = np.append(slots, -1)[at] == values
        offsets = np.r_[0, np.r_[0, np.cumsum(hit)][ends]].astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[hit].astype(np.int32)))], names=["label", "terms"])

    own = rows.mapInArrow(per_batch(chosen), "label int, terms array<int>").toArrow()
    if not own.num_rows:
        return fit(slots, [], np.empty(0))
    found = pa.concat_arrays(own["terms"].chunks)
    values, offsets = found.values.to_numpy(), found.offsets.to_numpy()
    # In an order of their own, so that the fit doesn't depend on how rows were dealt.
    keyed = sorted(((y, values[a:b]) for y, a, b in zip(own["label"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())), key=lambda x: (x[0], x[1].tobytes()))
    return fit(slots, [t for _, t in keyed], np.array([y for y, _ in keyed], float))


_held: list[tuple[FactorisationMachine, Terms]] = []


def _terms_of(model: FactorisationMachine) -> Terms:
    """One cache for each Python process, that of its latest model."""
    if not _held or _held[0][0] is not model:
        _held[:] = [(model, Terms(model.slots))]
    return _held[0][1]


def scorer(spark, model: FactorisationMachine):
    """A column function from text to score."""
    shared = spark.sparkContext.broadcast(model)
    return text_scorer(lambda texts: shared.value.score([_terms_of(shared.value)(t) for t in texts]))


def score_documents(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null and empty texts get the score of no terms.

    Scores depend on the text alone, so repeated rows score alike.  A null id
    counts as held out.  No rows for an empty table.  Without labelled rows to
    learn from every score is 0.001: nothing says that a text is toxic.
    """
    own = docs.select("doc_id", "text")
    score = scorer(docs.sparkSession, train(own, labels, target))
    found = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
