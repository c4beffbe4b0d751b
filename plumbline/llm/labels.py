"""Labelled rows for the classifiers: a bounded sample that may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_column

#: The most labelled rows that a classifier is fitted on; all of them where there are fewer.
MOST_LABELS = 30_000
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id) -> object:
    """Whether a row's label must not be learned from; rows without an id never are."""
    return F.coalesce(fold_column(doc_id, FOLDS) == HELD_OUT, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most: int = MOST_LABELS) -> DataFrame:
    """``(doc_id, text, label)`` of labelled documents outside the held-out fold, at most ``most`` by a hash of the id.

    The sample of labels has at most ``most`` rows of two numbers (1 MB) and is
    broadcast, so texts aren't shuffled.  A document with several labels counts
    with the largest; null labels are passed over.
    """
    own = labels.filter(F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
