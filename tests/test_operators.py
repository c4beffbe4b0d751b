import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline import queries
from plumbline.config import option_list, valid_ref
from plumbline.functions import scalar
from plumbline.functions.globs import skipped
from plumbline.functions.scalar import trend
from plumbline.operators import churn, clones, graph, intervals, textlog
from plumbline.operators.filters import ReportFilter
from plumbline.plans.scan import Scan
from plumbline.config import Config
from plumbline.sources import commands, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return round(x, 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def random_edges(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def brute_reach(roots, edges):
    seen = set(roots)
    while True:
        more = {d for s, d in edges if s in seen} - seen
        if not more:
            return seen
        seen |= more


@pytest.mark.parametrize("small", [10**6, 0])
def test_graph_against_brute_force(spark, small):
    rng = random.Random(1)
    edges = random_edges(rng, 14, 18)
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = {i: brute_reach([i], edges) for i in range(14)}
    roots = spark.createDataFrame([(0,), (3,)], "id long")
    assert {r[0] for r in graph.reachable(roots, df, small).collect()} == reach[0] | reach[3]
    want = {(i, min(x for x in range(14) if x in reach[i] and i in reach[x])) for i in range(14) if any(x != i and x in reach[i] and i in reach[x] for x in range(14))}
    assert {tuple(r) for r in graph.strong_components(df, small).collect()} == want


def brute_clones(docs, k, least):
    """Groups by the definition: positions by window, longest common length, thinning, line spans, greedy containment."""
    where = {}
    for p, (keys, _) in docs.items():
        for i in range(len(keys) - k + 1):
            where.setdefault(tuple(keys[i : i + k]), []).append((p, i))
    groups = []
    for spots in where.values():
        if len(spots) < 2:
            continue
        n = k
        while all(i + n < len(docs[p][0]) for p, i in spots) and len({docs[p][0][i + n] for p, i in spots}) == 1:
            n += 1
        kept, last = [], {}
        for p, i in sorted(spots):
            if i >= last.get(p, -(10**9)) + n:
                kept.append((p, docs[p][1][i], docs[p][1][i + n - 1]))
                last[p] = i
        height = max(e - s + 1 for _, s, e in kept)
        if len(kept) >= 2 and height >= least:
            groups.append((height, n, kept))
    groups.sort(key=lambda g: (-g[0], -g[1], min((p, s) for p, s, _ in g[2])))
    out = []
    for g in groups:
        if not all(any(p == q and a <= s and e <= b for h in out for q, a, b in h[2]) for p, s, e in g[2]):
            out.append(g)
    return {(h, n) for h, n, _ in out}, {x for _, _, own in out for x in own}


def test_clones_against_brute_force(spark):
    rng = random.Random(5)
    for seed in range(3):
        docs = {}
        block = [rng.choice("abcd") for _ in range(12)]
        for p in range(4):
            keys = [rng.choice("abcdef") for _ in range(8)] + block[: rng.randint(6, 12)] + [rng.choice("abcdef") for _ in range(5)] + block[: rng.randint(5, 12)]
            docs[f"f{p}"] = (keys, [i // 3 + 1 for i in range(len(keys))])
        df = spark.createDataFrame([(p, k, x) for p, (k, x) in docs.items()], "path string, keys array<string>, lines array<int>")
        found = clones.clone_groups(df, 5, 2).collect()
        heights, spans = brute_clones(docs, 5, 2)
        assert {(r.line_count, r.token_count) for r in found} == heights
        assert {(r.path, r.start_line, r.end_line) for r in found} == spans


def test_trend_bounds_are_strict(spark):
    rows = [(3, 2), (2, 3), (67, 100), (66, 100), (2, 0)]
    df = spark.createDataFrame([(a, b, a + b, 0, 9) for a, b in rows], "r long, o long, n long, lo long, hi long")
    got = [x[0] for x in df.select(trend(F.col("r"), F.col("o"), F.col("n"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["stable", "cooling", "stable", "cooling", "accelerating"]


def test_globs(spark):
    def hits(pattern, *paths):
        df = spark.createDataFrame([(p,) for p in paths], "path string")
        return [r.path for r in df.filter(skipped(F.col("path"), [pattern])).collect()]

    assert hits("made", "made", "made/X.java", "web/made/Y.java", "web/made", "web/maded/Z.java") == ["made", "made/X.java", "web/made/Y.java", "web/made"]
    assert hits("/top/", "top/", "top", "a/top") == ["top/"] and hits("web/", "web", "web/a") == ["web", "web/a"]
    assert hits("**/*Dto?.java", "p/q/BillDto2.java", "BillDto2.java", "p/BillDto.java") == ["p/q/BillDto2.java", "BillDto2.java"]
    assert hits("lib/*", "lib/a", "lib/a/b", "lib/a\n") == ["lib/a", "lib/a\n"]
    assert hits("[!a-c]{x,y}", "dx", "ax", "ey", "d/x") == ["dx", "ey"]


def test_options_and_revisions(spark):
    assert option_list(" A, b ,,C") == ["a", "b", "c"]
    good, bad = ["release/2.1", "main^2", "0f3c9aa", "topic@{yesterday}"], ["", "--all", "a|b", "main\n", "\nmain", "a\tb"]
    assert all(map(valid_ref, good)) and not any(map(valid_ref, bad))
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert [r.x for r in df.filter(scalar.valid_ref(F.col("x"))).collect()] == good


def lines(spark, text):
    return spark.createDataFrame([("t", i, x) for i, x in enumerate(text.split("\n"))], commands.LINES)


def test_diff(spark):
    text = """diff --git a/Bill.java b/Bill.java
--- a/Bill.java
+++ b/Bill.java
@@ -40,2 +37 @@ class Bill {
+y
+++ looks like a header
@@ -50,0 +52,4 @@
@@ -60,2 +59,0 @@
@@ -1 +99999999999,2 @@
@@ -1 +7,99999999999999999999 @@
@@ -1 +2147483647,3 @@
@@ broken @@
diff --git a/Cart.java b/Cart.java
new file mode 100644
--- /dev/null
+++ b/Cart.java
@@ -0,0 +1,9 @@
diff --git a/Gone.java b/Gone.java
+++ /dev/null
@@ -1,3 +0,0 @@"""
    got = {(r.path, r.start, r.end, r.is_new) for r in textlog.diff_ranges(lines(spark, text)).collect()}
    assert got == {("Bill.java", 37, 37, False), ("Bill.java", 52, 55, False), ("Bill.java", 2147483647, 2147483647, False), ("Cart.java", 1, 9, True)}


def test_dependency_report(spark):
    text = """[INFO] --- analyze (default-cli) @ shop ---
[WARNING] Used undeclared dependencies found:
[WARNING]    org.x:core:jar:3.1:compile
[ERROR] org.y:odd:jar:1
[WARNING]    org.x:late:jar:3.1:compile
[WARNING] Unused declared dependencies found:
[WARNING]    org.z:io:jar:2:test
[WARNING]    org.z:net:jar:2:compile
[WARNING]    org.z:io:jar:2:test
[INFO] Unused declared dependencies found: none
[WARNING]    org.q:no:jar:1:test

[INFO] BUILD SUCCESS"""
    got = {(r.kind, r.coord, r.line_no) for r in textlog.dependency_report(lines(spark, text)).collect()}
    assert got == {("undeclared", "org.x:core", 2), ("unused", "org.z:io", 6), ("unused", "org.z:net", 7)}


def test_log(spark):
    text = "COMMIT f00d 1700\n\n12\t0\tsrc/Bill.java\n-\t-\tlogo.java\n3\t1\tnotes.md\nCOMMIT beef never\n4\t4\tsrc/Cart.java"
    assert [(r.commit, r.ts, r.path, r.added, r.deleted) for r in textlog.commit_log(lines(spark, text)).collect()] == [("f00d", 1700, "src/Bill.java", 12, 0)]


def test_touching_spans_overlap(spark):
    spans = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("b", 1, 5)], "path string, line int, last int")
    ranges = spark.createDataFrame([("a", 5, 5)], "path string, start int, end int")
    assert [r.line for r in intervals.overlapping(spans, ranges, "path", "line", "last").collect()] == [1]


def test_a_group_shows_if_one_member_is_unskipped_and_another_changed(spark):
    members = spark.createDataFrame([(1, "gen/A"), (1, "B"), (2, "gen/C"), (3, "D")], "g long, path string")
    ranges = spark.createDataFrame([("gen/A", 1, 2), ("gen/C", 1, 2)], "path string, start int, end int")
    assert [r.g for r in ReportFilter(["gen"], ranges).groups(members, ["g"]).collect()] == [1]


def test_scan_of_a_small_project(spark, tmp_path):
    (tmp_path / "pom.xml").write_text("")
    src = tmp_path / "src"
    (tmp_path / "target").mkdir()
    src.mkdir()
    (tmp_path / "target" / "T.java").write_text("class T {}")
    (src / "_Main.java").write_text("package p; public class Main { public static void main(String[] a) { A x = new A(); } }")
    (src / "A.java").write_text("package p; public class A { B b; public void lonely() {} public void used() { b.used(); } }")
    (src / "B.java").write_text("package p; public class B { A a; public void used() {} }")
    (src / "Z.java").write_text("package p; class Z { }")
    (src / "bad.java").write_bytes(b"\xff\xfe class")
    assert files.find_project(src) == tmp_path.resolve()
    log = spark.createDataFrame([("c", 100, "src/A.java", 1, 1)], "commit string, ts long, path string, added long, deleted long")
    scan = Scan(files.source_files(spark, str(tmp_path)), log, Config(as_of=100, fail_on=["circular", "unused-files", "nope"]))
    assert {r.path for r in scan.files.collect()} == {"src/_Main.java", "src/A.java", "src/B.java", "src/Z.java"}
    assert [(r.files, r.cross_package) for r in scan.circular().collect()] == [(["src/A.java", "src/B.java"], False)]
    assert [r.path for r in scan.unused_files().collect()] == ["src/Z.java"]
    assert [r.name for r in scan.unused_exports().collect()] == ["lonely"]
    assert [r.file for r in scan.hotspots().collect()] == ["src/A.java"]
    gates = {r.target: (r.n, r.failed, r.message) for r in scan.gates(["circular", "unused-files"]).collect()}
    assert gates == {"circular": (1, True, "1 circular dependency"), "unused-files": (1, True, "1 unused file")}
    assert scan.targets().columns == ["path", "priority", "efficiency", "recommendation", "category", "effort", "confidence"]


def equal_histories(spark, paths=40):
    """Files of one history and of densities in sixteenths of the greatest, so the scores are ties of rounding."""
    rng = random.Random(3)
    seconds = [rng.randrange(1_600_000_000, queries.AS_OF) for _ in range(99)]
    rows = [(p, t, 1, 0) for p in range(paths) for t in rng.sample(seconds, len(seconds))]
    metrics = spark.createDataFrame([(p, p % 17 / 8.0, 1, 1) for p in range(paths)], "path long, density double, loc long, fan_in long")
    return churn.churn(spark.createDataFrame(rows, "path long, ts long, added long, deleted long").repartition(7), queries.AS_OF), metrics


def test_equal_histories_weigh_the_same(spark):
    churned, metrics = equal_histories(spark)
    assert churned.select("weighted_commits").distinct().count() == 1
    assert {r["file"]: r["score"] for r in churn.hotspots(churned, metrics).collect()} == {p: math.floor(p % 17 * 62.5 + 0.5) / 10 for p in range(40)}


def test_a_least_number_of_commits_keeps_ties(spark):
    churned, metrics = equal_histories(spark)
    few = churned.limit(0).unionByName(churned.select(*[(F.lit(59) if c == "total_commits" else F.col("path") + 40 if c == "path" else F.col(c)).alias(c) for c in churned.columns]))
    assert {r["file"]: r["score"] for r in churn.hotspots(churned.unionByName(few), metrics, 60).collect()} == {p: math.floor(p % 17 * 62.5 + 0.5) / 10 for p in range(40)}
