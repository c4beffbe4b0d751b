"""The module graph: name resolution, degrees, reachability, cycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import base_name, is_test_path
from ..runtime import append, discard, stash

#: Graphs of at most this many edges are solved in one task; larger ones by rounds of joins.
SMALL = 1_000_000

# Annotations that make a file an entry point.
ENTRY_ANNOTATIONS = "Component Service Repository Controller RestController Configuration Bean SpringBootApplication Entity Mapper Path".split()


def fqn_index(types: DataFrame) -> DataFrame:
    """``(fqn, path)``, the first path by name where several declare it."""
    return types.groupBy("fqn").agg(F.min("path").alias("path"))


def import_edges(files: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` between files: by plain, static and wildcard imports and within the package.

    Every way gives candidate names; their union meets the index in one join.
    """
    plain = files.select("path", F.explode("imports").alias("fqn"))
    static = files.select("path", F.explode("static_imports").alias("x")).select("path", F.explode(F.array("x", F.regexp_replace("x", r"\.[^.]*$", ""))).alias("fqn"))
    wild = files.select("path", "referenced", F.explode("wildcard_imports").alias("p")).select("path", "p", F.explode("referenced").alias("r")).select("path", F.concat_ws(".", "p", "r").alias("fqn"))
    near = files.filter(F.col("package") != "").select("path", "package", F.explode("referenced").alias("r")).select("path", F.concat_ws(".", "package", "r").alias("fqn"))
    names = plain.unionByName(static).unionByName(wild).unionByName(near).distinct()
    index = fqn_index(types).withColumnRenamed("path", "dst")
    return names.join(index, "fqn").filter(F.col("path") != F.col("dst")).select(F.col("path").alias("src"), "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, fan_in, fan_out)`` of each node over distinct edges."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counted = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fan_out", F.lit(0)).cast("long").alias("fan_out"))


def is_root(path: Column, annotations: Column, functions: Column) -> Column:
    """Tests, programs and what a framework finds by annotation."""
    return is_test_path(path) | F.exists(functions, lambda f: f["name"] == "main") | F.arrays_overlap(annotations, F.array(*map(F.lit, ENTRY_ANNOTATIONS)))


def file_facts(files: DataFrame) -> DataFrame:
    """One row a file: lines, branches per line, its hardest function, counts, and whether it is an entry point or holds a public type."""
    f = F.col("functions")
    return files.select(
        "path",
        F.col("line_count").alias("lines"),
        F.when(F.col("line_count") > 0, F.aggregate(f, F.lit(0).cast("long"), lambda s, x: s + x["cyclomatic"]) / F.col("line_count")).otherwise(0.0).alias("density"),
        F.coalesce(F.array_max(F.transform(f, lambda x: x["cognitive"])), F.lit(0)).alias("max_cognitive"),
        F.size("functions").alias("function_count"),
        F.size("exports").alias("export_count"),
        is_root(F.col("path"), F.col("annotations"), f).alias("is_root"),
        F.exists("types", lambda t: t["is_public"]).alias("is_public"),
    )


def with_fallback_roots(nodes: DataFrame) -> DataFrame:
    """``(id, is_root, is_public)``: if there is no root at all, what is public is one."""
    some = nodes.agg(F.coalesce(F.bool_or("is_root"), F.lit(False)).alias("some"))
    return nodes.crossJoin(F.broadcast(some)).select("id", F.when(F.col("some"), F.col("is_root")).otherwise(F.col("is_public")).alias("is_root"))


def _one_task(edges: DataFrame, more: DataFrame | None, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` over a small edge table; rows of ``more`` come as edges with a null end."""
    both = edges.select("src", "dst")
    if more is not None:
        both = both.unionByName(more.select(F.col("id").alias("src"), F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("dst")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if frames:
            yield work(pd.concat(frames, ignore_index=True))

    return both.repartition(1).mapInPandas(run, schema)


def reachable(roots: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct ``id`` that roots (``id``) reach, themselves included."""
    kind = dict(edges.dtypes)["src"]
    if edges.count() + roots.count() <= small:

        def walk(table: pd.DataFrame) -> pd.DataFrame:
            begin = table["dst"].isna()
            near: dict = {}
            for s, d in zip(table["src"][~begin], table["dst"][~begin]):
                near.setdefault(s, []).append(d)
            seen, stack = set(table["src"][begin]), list(set(table["src"][begin]))
            while stack:
                for d in near.get(stack.pop(), ()):
                    if d not in seen:
                        seen.add(d)
                        stack.append(d)
            return pd.DataFrame({"id": pd.Series(sorted(seen), dtype=table["src"].dtype)})

        return _one_task(edges, roots, walk, f"id {kind}")
    front = stash(roots.select("id").distinct(), "reach-front")
    seen = stash(front, "reach")
    while not front.isEmpty():
        found = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        last, front = front, stash(found.join(seen, "id", "left_anti"), "reach-front")
        discard(last)
        seen = append(seen, front)
    return seen


def unused_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes ``(id, is_root)`` that nothing reaches; package and module descriptions don't count."""
    return nodes.filter(~F.col("is_root") & ~base_name(F.col("id").cast("string")).isin("package-info.java", "module-info.java")).join(reached, "id", "left_anti").select("id")


def _components(table: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of two nodes or more, by Tarjan's walk with a stack of its own."""
    near: dict = {}
    for s, d in zip(table["src"], table["dst"]):
        near.setdefault(s, []).append(d)
    number, low, on, path, out = {}, {}, set(), [], []
    for start in sorted(near):
        if start in number:
            continue
        work = [(start, iter(near[start]))]
        number[start] = low[start] = len(number)
        path.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for d in rest:
                if d not in number:
                    number[d] = low[d] = len(number)
                    path.append(d)
                    on.add(d)
                    work.append((d, iter(near.get(d, ()))))
                    break
                if d in on:
                    low[node] = min(low[node], number[d])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(path.pop())
                        on.discard(own[-1])
                    if len(own) > 1:
                        out += [(x, min(own)) for x in own]
    return pd.DataFrame({"id": pd.Series([x for x, _ in out], dtype=table["src"].dtype), "scc": pd.Series([c for _, c in out], dtype=table["src"].dtype)})


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``(id, scc)`` of nodes in a cycle; ``scc`` is the component's least node.

    Beyond ``small`` edges: nodes without a way in or out are trimmed, the
    least node that reaches each colours it, and from each colour's own node
    what walks back within the colour is a component; then on with the rest.
    """
    kind = dict(edges.dtypes)["src"]
    own = edges.select("src", "dst").filter("src <> dst").distinct()
    if own.count() <= small:
        return _one_task(own, None, _components, f"id {kind}, scc {kind}")
    left, found = stash(own, "scc-edges"), own.sparkSession.createDataFrame([], f"id {kind}, scc {kind}")
    while not left.isEmpty():
        while True:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            inner = stash(inner, "scc-edges")
            if inner.count() == left.count():
                break
            left = inner
        if left.isEmpty():
            break
        colours = stash(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), "scc-colours")
        while True:
            told = left.join(colours, left["src"] == colours["id"]).groupBy("dst").agg(F.min("colour").alias("told"))
            new = stash(colours.join(told, colours["id"] == told["dst"], "left").select("id", F.least("colour", "told").alias("colour"), (F.col("told") < F.col("colour")).alias("turned")), "scc-colours")
            same = new.filter("turned").isEmpty()
            discard(colours)
            colours = new.select("id", "colour")
            if same:
                break
        a, b = colours.select(F.col("id").alias("src"), F.col("colour").alias("ca")), colours.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        within = stash(left.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst"), "scc-within")
        # Backwards from the colours' own nodes: a walk never leaves its colour.
        back = reachable(colours.filter("id = colour").select("id"), within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), small)
        part = stash(back.join(colours, "id").select("id", F.col("colour").alias("scc")), "scc-part")
        sizes = part.groupBy("scc").count().filter("count > 1").select("scc")
        found = found.unionByName(part.join(sizes, "scc", "left_semi").select("id", "scc"))
        gone = part.select("id")
        left = stash(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
    return stash(found, "scc")


def cycles(components: DataFrame, packages: DataFrame) -> DataFrame:
    """``(files, size, cross_package)`` of each component, by ``packages`` of ``(id, package)``."""
    joined = components.join(packages, "id", "left")
    return joined.groupBy("scc").agg(F.array_sort(F.collect_set("id")).alias("files"), F.count("*").alias("size"), (F.count_distinct("package") > 1).alias("cross_package")).drop("scc")
