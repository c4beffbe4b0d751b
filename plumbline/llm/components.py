"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps (Kiveris et al. 2014) with a
union-find inside every partition before them.  Each round's edges are written
to the shared folder, so lineage stays short and a lost executor repeats one
round at most; what no later round reads is deleted.  Nothing is gathered to
the driver but whether a round was the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Edges that one union-find holds; a partition with more is contracted piece by piece.
BLOCK = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Stars of the components of some edges: each node that isn't its component's least, with the least one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return nodes, [find(x) for x in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nodes, roots = _forest(np.concatenate(us), np.concatenate(vs))
        us.clear()
        vs.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["v", "u"])

    for batch in batches:
        us.append(batch.column(1).to_numpy())
        vs.append(batch.column(0).to_numpy())
        held += batch.num_rows
        if held >= BLOCK:
            yield flush()
            held = 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", small: int = BLOCK) -> DataFrame:
    """``(node, root)`` for every node with an edge to another node; root is the component's least node.

    Edges are undirected pairs of longs.  Self-loops and pairs with a null are
    passed over; repeated pairs count once.  No edges give no rows.  What a
    first contraction leaves goes to one task if it is ``small``.
    """
    def named(stars: DataFrame) -> DataFrame:
        roots = stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
        return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)

    a, b = F.col(left), F.col(right)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    while True:
        now, before = stash(now.mapInArrow(_contract, "v long, u long"), "components"), now
        discard(before)
        if now.count() <= min(small, BLOCK):
            stars = stash(now.coalesce(1).mapInArrow(_contract, "v long, u long"), "components")
            discard(now)
            return named(stars)
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        # The minima are written, so that the joins deal both sides anew and the edges of one node can be split.
        near = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-near")
        large = stash(both.filter("b > a").join(near, "a").select(F.col("b").alias("v"), F.col("m").alias("u")).distinct(), "components-large")
        least = stash(large.groupBy("v").agg(F.min("u").alias("m")), "components-least")
        small = large.join(least, "v")
        contracted = now
        now = stash(small.select("v", F.col("m").alias("u")).unionByName(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct(), "components")
        discard(contracted, near, large, least)
        inner = now.select("u").distinct().join(now.select(F.col("v").alias("u")), "u", "left_semi")
        split = now.groupBy("v").count().filter("count > 1")
        if inner.isEmpty() and split.isEmpty():  # every node hangs from one root: stars
            break
    return named(now)
