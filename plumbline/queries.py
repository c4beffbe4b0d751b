"""One query for each operator over the driver's tables, with DuckDB's SQL for those that SQL can express.

The analyses work on any table with suitable columns; here customers, parts,
orders and documents stand in for files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.globs import skipped
from .functions.scalar import base_name, counted, efficiency_band, epoch, line_count, option_entries, relative, rounded, score_band, topic_key, valid_ref
from .operators import churn, clones, exports, functions, graph, intervals, ranking, targets, textlog
from .operators.filters import ReportFilter
from .operators.gates import gates
from .plans.topics import find, topics
from .runtime import stash
from .sources.files import parse_sources, tokenize_sources
from .streaming.churn import daily_counts, decayed

AS_OF = 1_706_745_600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- churn and hotspots: users as files, events as commits ---


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), epoch(F.col("ts")).alias("ts"), F.floor("value").cast("long").alias("added"), F.lit(1).cast("long").alias("deleted"))


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (F.pmod(F.col("c_custkey"), F.lit(17)) / F.lit(8.0)).alias("density"), (F.col("c_custkey") * 3).alias("loc"), F.pmod(F.col("c_custkey"), F.lit(7)).alias("fan_in"))


LOG_SQL = "log AS (SELECT user_id AS path, floor(epoch(ts))::BIGINT AS ts, floor(value)::BIGINT AS added, 1::BIGINT AS deleted FROM events)"
CHURN_SQL = (
    LOG_SQL
    + f""", spans AS (SELECT path, min(ts) + (max(ts) - min(ts)) // 2 AS mid, min(ts) AS low, max(ts) AS high FROM log GROUP BY path),
churn AS (SELECT path, sum(exp(-({AS_OF} - ts) * (ln(2) / 7776000))) AS weighted, count(*) AS n, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted,
  count(*) FILTER (ts > mid) AS recent, count(*) FILTER (ts <= mid) AS older, min(low) AS low, max(high) AS high FROM log JOIN spans USING (path) GROUP BY path),
trended AS (SELECT *, CASE WHEN n < 2 OR low = high THEN 'stable' WHEN older = 0 OR recent / older > 1.5 THEN 'accelerating' WHEN recent / older < 0.67 THEN 'cooling' ELSE 'stable' END AS trend FROM churn)"""
)
METRICS_SQL = "metrics AS (SELECT c_custkey AS path, (c_custkey % 17) / 8.0::DOUBLE AS density, c_custkey * 3 AS loc, c_custkey % 7 AS fan_in FROM customer)"


def _hot_sql(least: int) -> str:
    return f"""joined AS (SELECT t.path, weighted, n, added + deleted AS lines, trend, coalesce(density, 0)::DOUBLE AS density, coalesce(loc, 0)::BIGINT AS loc, coalesce(fan_in, 0)::BIGINT AS fan_in
  FROM trended t LEFT JOIN metrics USING (path) WHERE n >= {least}),
hot AS (SELECT path AS file, CASE WHEN max(weighted) OVER () > 0 AND max(density) OVER () > 0 THEN floor(weighted / max(weighted) OVER () * (density / max(density) OVER ()) * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS score,
  floor(weighted * 100 + 0.5) / 100 AS weighted_commits, n AS total_commits, loc, lines::BIGINT AS churn_lines, floor(density * 100 + 0.5) / 100 AS density, fan_in, trend FROM joined)"""


@query(f"WITH {CHURN_SQL}, {METRICS_SQL}, {_hot_sql(1)} SELECT * FROM hot")
def hotspot_decay(spark, sf_dir):
    """Churn, density, shares of the greatest: the flagship query."""
    return churn.hotspots(churn.churn(_log(spark, sf_dir), AS_OF), _metrics(spark, sf_dir))


@query(f"WITH {CHURN_SQL} SELECT path, n AS total_commits, added, deleted, floor(weighted * 100 + 0.5) / 100 AS weighted_commits, trend FROM trended")
def churn_trend(spark, sf_dir):
    found = churn.churn(_log(spark, sf_dir), AS_OF)
    return found.select("path", "total_commits", "added", "deleted", rounded(F.col("weighted_commits"), 2).alias("weighted_commits"), "trend")


@query(f"WITH {CHURN_SQL}, {METRICS_SQL}, {_hot_sql(60)} SELECT * FROM hot")
def hotspot_min_commits(spark, sf_dir):
    return churn.hotspots(churn.churn(_log(spark, sf_dir), AS_OF), _metrics(spark, sf_dir), 60)


@query(f"WITH {CHURN_SQL}, {METRICS_SQL}, {_hot_sql(1)} SELECT file, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS band FROM hot ORDER BY score DESC, file LIMIT 20")
def topk_hotspots(spark, sf_dir):
    best = ranking.top(hotspot_decay(spark, sf_dir), [F.desc("score"), F.asc("file")], 20)
    return best.select("file", "score", score_band(F.col("score")).alias("band"))


@query("SELECT user_id AS path, date_trunc('day', ts)::VARCHAR[1:10] AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_churn(spark, sf_dir):
    found = daily_counts(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.select("path", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


SQL["daily_churn"] = "SELECT user_id AS path, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL"


@query(f"""SELECT user_id AS path, floor(sum(pow(0.5, ({AS_OF} - epoch(date_trunc('day', ts))) / 7776000)) * 100 + 0.5) / 100 AS weighted_commits, count(*) AS total_commits FROM events GROUP BY ALL""")
def decayed_daily(spark, sf_dir):
    found = decayed(daily_counts(table(spark, sf_dir, "events"), "user_id", "ts"), AS_OF)
    return found.select("path", rounded(F.col("weighted_commits"), 2).alias("weighted_commits"), "total_commits")


# --- functions: line items as functions of parts ---


def _functions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.concat_ws(".", "l_orderkey", "l_suppkey", "l_linenumber").alias("name"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("int").alias("cyclomatic"), F.pmod(F.col("l_suppkey") + F.col("l_linenumber") * 7, F.lit(45)).cast("int").alias("cognitive"), F.pmod(F.col("l_orderkey") * 3 + F.col("l_linenumber"), F.lit(90)).cast("int").alias("line_count")).distinct()


FUNCTIONS_SQL = """fns AS (SELECT DISTINCT 'p' || l_partkey AS path, l_orderkey || '.' || l_suppkey || '.' || l_linenumber AS name, l_linenumber::INT AS line, l_quantity::INT AS cyclomatic,
 ((l_suppkey + l_linenumber * 7) % 45)::INT AS cognitive, ((l_orderkey * 3 + l_linenumber) % 90)::INT AS line_count FROM lineitem),
flagged AS (SELECT *, CASE WHEN cyclomatic > 20 AND cognitive > 15 THEN 'both' WHEN cyclomatic > 20 THEN 'cyclomatic' WHEN cognitive > 15 THEN 'cognitive' END AS exceeded,
 CASE WHEN cyclomatic >= 50 OR cognitive >= 40 THEN 'critical' WHEN cyclomatic >= 30 OR cognitive >= 25 THEN 'high' ELSE 'medium' END AS severity FROM fns),
violations AS (SELECT * FROM flagged WHERE exceeded IS NOT NULL)"""
ORDER_SQL = "(CASE exceeded WHEN 'both' THEN 2 ELSE 1 END) DESC, (CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE 0 END) DESC, cyclomatic DESC, cognitive DESC, line_count DESC, path, line, name"


@query(f"WITH {FUNCTIONS_SQL} SELECT path, name, line, cyclomatic, cognitive, line_count, exceeded, severity FROM violations")
def complexity_violations(spark, sf_dir):
    return functions.violations(_functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS_SQL} SELECT path, name, line, line_count FROM fns WHERE line_count > 60")
def large_functions(spark, sf_dir):
    return functions.large_functions(_functions(spark, sf_dir))


@query(
    f"""WITH {FUNCTIONS_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS rn FROM violations),
placed AS (SELECT *, min(rn) OVER (PARTITION BY path) AS g FROM ranked)
SELECT path, name, line, cyclomatic, cognitive, exceeded, severity, (row_number() OVER (ORDER BY g, rn))::INT AS place FROM placed ORDER BY g, rn LIMIT 50"""
)
def grouped_topn(spark, sf_dir):
    found = ranking.grouped_top(complexity_violations(spark, sf_dir), "path", functions.violation_order(), 50)
    return found.select("path", "name", "line", "cyclomatic", "cognitive", "exceeded", "severity", "place")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, len(string_split(text, chr(10))) > 60 AS is_large FROM documents")
def text_line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", line_count(F.col("text")).alias("lines"), (line_count(F.col("text")) > 60).alias("is_large"))


# --- exports: part kinds declared and ordered ---


@query(
    """WITH used AS (SELECT DISTINCT l_suppkey AS path, l_orderkey AS name FROM lineitem WHERE l_returnflag = 'R'),
ex AS (SELECT CASE WHEN s % 11 = 0 THEN 'src/test/s' ELSE 'src/s' END || s AS path, n AS name, (n % 97)::INT AS line FROM (SELECT DISTINCT l_suppkey AS s, l_orderkey AS n FROM lineitem)),
us AS (SELECT CASE WHEN path % 11 = 0 THEN 'src/test/s' ELSE 'src/s' END || path AS path, name FROM used)
SELECT path, name, line FROM ex WHERE NOT contains('/' || path, '/test/') AND NOT EXISTS (SELECT 1 FROM us WHERE us.name = ex.name AND us.path <> ex.path)"""
)
def unused_exports(spark, sf_dir):
    """Suppliers as files: they declare the orders of all their items and name those of which an item came back."""
    line = table(spark, sf_dir, "lineitem")
    path = F.concat(F.when(F.col("s") % 11 == 0, "src/test/s").otherwise("src/s"), F.col("s").cast("string"))
    rows = line.select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("name"), "l_returnflag")
    declared = rows.select("s", "name").distinct().select(path.alias("path"), "name", F.pmod("name", F.lit(97)).cast("int").alias("line"))
    used = rows.filter("l_returnflag = 'R'").select("s", "name").distinct().select(path.alias("path"), "name")
    return exports.unused_exports(declared, used)


# --- the graph: orders as files; each leads to its customer's next, a finished one back to the customer's first ---


def _edges(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ahead = F.lead("o_orderkey").over(w)
    back = F.when(F.col("o_orderstatus") == "F", F.first("o_orderkey").over(w))
    pairs = own.select(F.col("o_orderkey").alias("src"), ahead.alias("ahead"), back.alias("back")).select("src", F.explode(F.array("ahead", "back")).alias("dst"))
    return pairs.filter("dst is not null and src <> dst").distinct()


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50 + 1).alias("size"), F.col("o_orderpriority").alias("package"), (F.col("o_orderpriority") == "1-URGENT").alias("is_root"))


EDGES_SQL = """hops AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS ahead, CASE WHEN o_orderstatus = 'F' THEN first_value(o_orderkey) OVER w END AS back
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT src, ahead AS dst FROM hops WHERE ahead IS NOT NULL UNION SELECT src, back FROM hops WHERE back <> src)"""


@query(f"WITH {EDGES_SQL} SELECT o_orderkey AS id, (SELECT count(*) FROM edges WHERE dst = o_orderkey) AS fan_in, (SELECT count(*) FROM edges WHERE src = o_orderkey) AS fan_out FROM orders")
def edge_degrees(spark, sf_dir):
    return graph.degrees(_nodes(spark, sf_dir), _edges(spark, sf_dir))


REACH_SQL = f"""{EDGES_SQL}, roots AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), reach AS (SELECT id FROM roots UNION SELECT dst FROM reach JOIN edges ON src = id)"""


@query(f"WITH RECURSIVE {REACH_SQL} SELECT id FROM reach")
def reachability(spark, sf_dir):
    return graph.reachable(_nodes(spark, sf_dir).filter("is_root").select("id"), _edges(spark, sf_dir))


_FILE_SQL = "'src/p' || o_orderkey || CASE o_orderkey % 10 WHEN 3 THEN '/package-info.java' WHEN 7 THEN '/module-info.java' ELSE '/A.java' END"


@query(f"WITH RECURSIVE {REACH_SQL} SELECT {_FILE_SQL} AS id FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 10 NOT IN (3, 7) AND o_orderkey NOT IN (SELECT id FROM reach)")
def unused_nodes(spark, sf_dir):
    """Ids as paths, of which some describe a package or module."""
    k = F.col("id") % 10
    path = F.concat(F.lit("src/p"), F.col("id").cast("string"), F.when(k == 3, "/package-info.java").when(k == 7, "/module-info.java").otherwise("/A.java")).alias("id")
    return graph.unused_nodes(_nodes(spark, sf_dir).select(path, "is_root"), reachability(spark, sf_dir).select(path))


@query("SELECT 'part' AS kind, p_partkey AS id, p_retailprice > 900 AS is_root FROM part UNION ALL SELECT 'supplier', s_suppkey, s_nationkey < 5 FROM supplier")
def fallback_roots(spark, sf_dir):
    """No part is a root, so those that are public are; some suppliers are roots, and then they alone."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(False).alias("is_root"), (F.col("p_retailprice") > 900).alias("is_public"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 5).alias("is_root"), (F.col("s_acctbal") > 0).alias("is_public"))
    return graph.with_fallback_roots(parts).withColumn("kind", F.lit("part")).unionByName(graph.with_fallback_roots(suppliers).withColumn("kind", F.lit("supplier")))


SCC_SQL = f"""{EDGES_SQL}, walk AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM walk JOIN edges ON b = src),
scc AS (SELECT x.a AS id, least(x.a, min(x.b)) AS scc FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""


@query(f"WITH RECURSIVE {SCC_SQL} SELECT list_sort(list(id)) AS files, count(*) AS size, count(DISTINCT o_orderpriority) > 1 AS cross_package FROM scc JOIN orders ON id = o_orderkey GROUP BY scc")
def scc_cycles(spark, sf_dir):
    return graph.cycles(graph.strong_components(_edges(spark, sf_dir)), _nodes(spark, sf_dir).select("id", "package"))


DEGREE_SQL = "SELECT o_orderkey AS id, (SELECT count(*) FROM edges WHERE dst = o_orderkey) AS fan_in, (SELECT count(*) FROM edges WHERE src = o_orderkey) AS fan_out FROM orders"
THRESHOLD_SQL = ", ".join(f"greatest(coalesce(quantile_disc({c}, {p}), 0)::DOUBLE, {floor}.0::DOUBLE) AS {name}" for name, (c, p, floor) in targets.PERCENTILES.items())


@query(f"WITH {EDGES_SQL}, degree AS ({DEGREE_SQL}) SELECT {THRESHOLD_SQL} FROM degree")
def percentile_thresholds(spark, sf_dir):
    return targets.thresholds(edge_degrees(spark, sf_dir))


@query(
    """WITH words AS (SELECT doc_id, unnest(list_distinct(string_split_regex(text, '[ \\n]+'))) AS w FROM documents),
idx AS (SELECT w AS fqn, min(doc_id) AS dst FROM words GROUP BY w)
SELECT DISTINCT doc_id AS src, dst FROM words JOIN idx ON w = fqn WHERE doc_id <> dst"""
)
def import_edges(spark, sf_dir):
    """Words as names: every document declares and imports all its words."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.array_distinct(F.split("text", "[ \n]+")).alias("imports"))
    none = F.array().cast("array<string>")
    files = words.withColumns({"static_imports": none, "wildcard_imports": none, "referenced": none, "package": F.lit("")})
    types = words.select(F.explode("imports").alias("fqn"), "path")
    return graph.import_edges(files, types)


@query(
    """WITH named AS (SELECT c_custkey AS k, c_nationkey AS p, 'n' || c_nationkey || '.C' || c_custkey AS fqn FROM customer),
far AS (SELECT a.k, a.p, b.fqn AS plain, c.fqn AS member FROM named a LEFT JOIN named b ON b.k = a.k + 7 LEFT JOIN named c ON c.k = a.k + 11),
refs AS (SELECT k, p, unnest(generate_series(k + 1, k + 60)) AS r FROM named)
SELECT k AS src, k + 7 AS dst FROM far WHERE plain IS NOT NULL UNION SELECT k, k + 11 FROM far WHERE member IS NOT NULL
UNION SELECT refs.k, r FROM refs JOIN named ON named.k = r WHERE named.p = (refs.p + 1) % 25 OR named.p = refs.p AND refs.p % 2 = 0"""
)
def import_kinds(spark, sf_dir):
    """Customers as files, nations as packages: a plain and a static import, a wildcard of the next nation, and neighbours in even nations; odd ones are the default package."""
    k, p = F.col("c_custkey"), F.col("c_nationkey")
    named = table(spark, sf_dir, "customer").select(k.alias("k"), p.alias("p"), F.concat(F.lit("n"), p.cast("string"), F.lit(".C"), k.cast("string")).alias("fqn"))
    other = lambda step, name: named.select((F.col("k") - step).alias("k"), F.col("fqn").alias(name))
    files = named.join(other(7, "plain"), "k", "left").join(other(11, "owner"), "k", "left").select(
        F.col("k").alias("path"),
        F.when(F.col("p") % 2 == 0, F.concat(F.lit("n"), F.col("p").cast("string"))).otherwise("").alias("package"),
        F.array_compact(F.array("plain")).alias("imports"),
        F.array_compact(F.array(F.concat("owner", F.lit(".member")))).alias("static_imports"),
        F.array(F.concat(F.lit("n"), ((F.col("p") + 1) % 25).cast("string"))).alias("wildcard_imports"),
        F.transform(F.sequence(F.col("k") + 1, F.col("k") + 60), lambda r: F.concat(F.lit("C"), r.cast("string"))).alias("referenced"),
    )
    return graph.import_edges(files, named.select("fqn", F.col("k").alias("path")))


# --- refactoring targets: facts of orders ---


@query(
    f"""WITH {EDGES_SQL}, degree AS ({DEGREE_SQL}), file AS (SELECT o_orderkey AS id, o_custkey % 50 + 1 AS size, o_orderpriority = '1-URGENT' AS is_root FROM orders), th AS (SELECT {THRESHOLD_SQL} FROM degree),
facts AS (SELECT id AS path, size * 12 AS lines, (id % 13) / 16.0::DOUBLE AS density, (id % 41)::INT AS max_cognitive, (id % 19)::INT AS function_count, fan_in, fan_out, is_root,
  (id % 101)::DOUBLE AS hotspot, CASE WHEN id % 3 = 0 THEN 'accelerating' ELSE 'stable' END AS trend, id % 23 = 0 AS is_circular, (id % 5)::INT AS export_count,
  CASE WHEN id % 5 > 0 AND id % 2 = 0 THEN 1.0 / (id % 5) ELSE 0.0 END::DOUBLE AS dead_ratio FROM file JOIN degree USING (id)),
ruled AS (SELECT *, CASE WHEN hotspot >= 50 AND trend = 'accelerating' AND density > 0.5 THEN 'churn+complexity' WHEN is_circular AND fan_in >= 5 THEN 'circular dependency'
  WHEN density > 0.3 AND (fan_in >= in_p95 OR (fan_in >= in_p75 AND function_count >= 5)) THEN 'high impact' WHEN dead_ratio >= 0.5 AND export_count >= 3 THEN 'dead code'
  WHEN max_cognitive >= 30 THEN 'complexity' WHEN NOT is_root AND fan_out >= out_p90 THEN 'coupling' WHEN is_circular THEN 'circular dependency' END AS category,
  floor(least(greatest(least(density, 1) * 30 + hotspot / 100 * 25 + dead_ratio * 20 + least(fan_in / in_p95, 1) * 15 + least(fan_out / out_p95, 1) * 10, 0), 100) * 10 + 0.5) / 10 AS priority,
  CASE WHEN lines >= 500 OR fan_in >= in_p95 OR (function_count >= 15 AND density > 0.5) THEN 3 WHEN lines < 100 AND function_count <= 3 AND fan_in < in_p25 THEN 1 ELSE 2 END AS cost FROM facts, th)
SELECT path, category, priority, floor(priority / cost * 10 + 0.5) / 10 AS efficiency, CASE cost WHEN 1 THEN 'low' WHEN 3 THEN 'high' ELSE 'medium' END AS effort,
  CASE category WHEN 'churn+complexity' THEN 'low' WHEN 'high impact' THEN 'medium' WHEN 'coupling' THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN floor(priority / cost * 10 + 0.5) / 10 >= 40 THEN 'high' WHEN floor(priority / cost * 10 + 0.5) / 10 >= 20 THEN 'medium' ELSE 'low' END AS band FROM ruled WHERE category IS NOT NULL"""
)
def refactoring_targets(spark, sf_dir):
    nodes, k = _nodes(spark, sf_dir), F.col("id")
    own = nodes.select(k.alias("path"), (F.col("size") * 12).alias("lines"), (k % 13 / 16.0).alias("density"), (k % 41).cast("int").alias("max_cognitive"), (k % 19).cast("int").alias("function_count"), (k % 5).cast("int").alias("export_count"), "is_root")
    files = own.join(edge_degrees(spark, sf_dir).withColumnRenamed("id", "path"), "path")
    hot = nodes.select(k.alias("file"), (k % 101).cast("double").alias("score"), F.when(k % 3 == 0, "accelerating").otherwise("stable").alias("trend"))
    unused = nodes.filter("id % 5 > 0 and id % 2 = 0").select(k.alias("path"))
    facts = stash(targets.assemble(files, hot, nodes.filter("id % 23 = 0").select(k.alias("path")), unused), "target-facts")
    found = targets.targets(facts)
    return found.select("path", "category", "priority", "efficiency", "effort", "confidence", efficiency_band(F.col("efficiency")).alias("band"))


# --- intervals and filters ---


def _spans(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("name"), (F.col("l_suppkey") * 3).cast("int").alias("line"), F.col("l_quantity").cast("int").alias("line_count")).distinct()


def _ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("path"), F.pmod(F.col("o_orderkey"), F.lit(300)).cast("int").alias("start"), (F.pmod(F.col("o_orderkey"), F.lit(300)) + 9).cast("int").alias("end")).distinct()


SPANS_SQL = """spans AS (SELECT DISTINCT l_partkey AS path, l_orderkey AS name, (l_suppkey * 3)::INT AS line, l_quantity::INT AS line_count FROM lineitem),
ranges AS (SELECT DISTINCT o_custkey * 2 AS path, (o_orderkey % 300)::INT AS s, (o_orderkey % 300 + 9)::INT AS e FROM orders)"""


@query(f"WITH {SPANS_SQL} SELECT * FROM spans x WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.path = x.path AND r.s <= x.line + greatest(x.line_count - 1, 0) AND x.line <= r.e)")
def overlap_filter(spark, sf_dir):
    return ReportFilter([], _ranges(spark, sf_dir)).functions(_spans(spark, sf_dir))


@query(f"WITH {SPANS_SQL} SELECT name FROM spans GROUP BY name HAVING bool_or(path % 7 <> 0) AND bool_or(path IN (SELECT path FROM ranges))")
def multi_member_filter(spark, sf_dir):
    members = _spans(spark, sf_dir).select("name", F.col("path").cast("string").alias("path")).filter("true")
    ranges = _ranges(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    # Paths divisible by seven are hidden, by a folder that a bare name skips.
    hide = lambda df: df.withColumn("path", F.when(F.col("path").cast("long") % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    return ReportFilter(["old"], hide(ranges)).groups(hide(members), ["name"])


@query(f"WITH {SPANS_SQL} SELECT DISTINCT path FROM spans WHERE path IN (SELECT path FROM ranges)")
def changed_files(spark, sf_dir):
    return ReportFilter([], _ranges(spark, sf_dir)).files(_spans(spark, sf_dir).select("path").distinct())


SKIPS = ["promo", "brand#13/", "small/*", "**/brand#2[0-2]/*", "economy/**/p1?.java", "{medium,large}/brand#3*/p*7.java"]
PATH_SQL = "lower(p_type) || '/' || lower(p_brand) || '/p' || p_size || '.java'"


@query(
    f"""WITH paths AS (SELECT p_partkey, {PATH_SQL} AS path, lower(p_type) AS kind, lower(p_brand) AS brand, p_size FROM part)
SELECT p_partkey, path FROM paths WHERE kind <> 'promo' AND brand <> 'brand#13' AND brand NOT IN ('brand#20', 'brand#21', 'brand#22')
AND NOT (kind = 'economy' AND p_size BETWEEN 10 AND 19) AND NOT (kind IN ('medium', 'large') AND starts_with(brand, 'brand#3') AND p_size % 10 = 7)"""
)
def glob_skip(spark, sf_dir):
    path = F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit("/p"), F.col("p_size").cast("string"), F.lit(".java"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).filter(~skipped(F.col("path"), SKIPS))


@query(f"WITH {SPANS_SQL}, new AS (SELECT DISTINCT o_custkey * 2 AS path FROM orders WHERE o_orderstatus = 'F') SELECT DISTINCT path FROM spans WHERE path IN (SELECT path FROM new)")
def added_files(spark, sf_dir):
    """Files with a finished order are new ones."""
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select((F.col("o_custkey") * 2).alias("path")).distinct()
    return ReportFilter([], _ranges(spark, sf_dir), new).new_files(_spans(spark, sf_dir).select("path").distinct())


@query(f"WITH {SPANS_SQL} SELECT DISTINCT name FROM spans x WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.path = x.path AND r.s <= x.line + x.line_count AND x.line <= r.e)")
def line_groups(spark, sf_dir):
    """Groups of which a member's lines were changed."""
    members = _spans(spark, sf_dir).select("name", "path", F.col("line").alias("start_line"), (F.col("line") + F.col("line_count")).alias("end_line"))
    return ReportFilter([], _ranges(spark, sf_dir)).groups(members, ["name"], lines=True)


@query("SELECT 'full' AS report, s_suppkey AS coord FROM supplier UNION ALL SELECT 'build file changed', s_suppkey FROM supplier")
def shown_dependencies(spark, sf_dir):
    """Dependencies in a full report and in one where a build file was changed; none in one where none was."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("coord"))
    changed = lambda name: table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.lit(name)).alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end"))
    shown = {"full": ReportFilter(), "build file changed": ReportFilter([], changed("/pom.xml")), "others changed": ReportFilter([], changed("/A.java"))}
    return reduce(DataFrame.unionByName, [f.dependencies(rows).withColumn("report", F.lit(name)) for name, f in shown.items()])


@query(f"WITH {CHURN_SQL}, {METRICS_SQL}, {_hot_sql(1)} SELECT file, score FROM hot WHERE file % 10 <> 3")
def shown_hotspots(spark, sf_dir):
    """Skipped folders hide hotspots; a comparison shows none of them, so its rows add nothing."""
    found = hotspot_decay(spark, sf_dir).select(F.concat(F.when(F.col("file") % 10 == 3, "gen/").otherwise("src/"), F.col("file").cast("string")).alias("file"), "score")
    shown = ReportFilter(["gen"]).hotspots(found).unionByName(ReportFilter(["gen"], _ranges(spark, sf_dir)).hotspots(found))
    return shown.select(F.substring("file", 5, 20).cast("long").alias("file"), "score")


@query("SELECT 's' || (o_orderkey % 50) AS source, 'src/N' || o_orderkey || '.java' AS path, 1 AS start, 2147483647 AS \"end\", true AS is_new FROM orders")
def untracked_files(spark, sf_dir):
    k = F.col("o_orderkey")
    return textlog.untracked(table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (k % 50).cast("string")).alias("source"), F.concat(F.lit("src/N"), k.cast("string"), F.lit(".java")).alias("path")))


@query(
    """WITH iv AS (SELECT l_orderkey AS g, l_partkey // 4 AS path, (l_suppkey % 50)::INT AS s, (l_suppkey % 50 + l_quantity)::INT AS e, l_linenumber FROM lineitem),
inst AS (SELECT DISTINCT g, path, s, e FROM iv), heads AS (SELECT g, max(e - s + 1) AS h FROM inst GROUP BY g),
rk AS (SELECT g, h, row_number() OVER (ORDER BY h DESC, g) AS r FROM heads), own AS (SELECT * FROM inst JOIN rk USING (g))
SELECT g AS group_id, path, s AS start_line, e AS end_line, h AS line_count FROM own o WHERE EXISTS (SELECT 1 FROM own x WHERE x.g = o.g AND NOT EXISTS
 (SELECT 1 FROM own y WHERE y.path = x.path AND y.s <= x.s AND x.e <= y.e AND y.r < x.r))"""
)
def containment_prune(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    own = line.select(F.col("l_orderkey").alias("group_id"), F.expr("l_partkey div 4").alias("path"), (F.col("l_suppkey") % 50).cast("int").alias("start_line"), (F.col("l_suppkey") % 50 + F.col("l_quantity")).cast("int").alias("end_line")).distinct()
    heads = own.groupBy("group_id").agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("line_count"))
    return intervals.prune_contained(own.join(heads, "group_id"), [("line_count", True), ("group_id", False)])


# --- clones: documents as files, words as tokens ---


def _token_files(spark, sf_dir):
    lines = F.split("text", "\n")
    words = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("key"), (i + 1).alias("line")))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), words.alias("t")).select("path", F.col("t.key").alias("keys"), F.col("t.line").alias("lines"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS k FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(k[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, k, unnest(generate_series(0, len(k) - 50)) AS i FROM w WHERE len(k) >= 50)),
c AS (SELECT h, count(*) AS members, min(doc_id) AS first_path, count(DISTINCT doc_id) AS files FROM g GROUP BY h HAVING count(*) > 1)
SELECT members, first_path, files, count(*) AS classes FROM c GROUP BY ALL"""
)
def kgram_classes(spark, sf_dir):
    grams = clones.kgrams(_token_files(spark, sf_dir), 50)
    classes = grams.groupBy("gram").agg(F.count("*").alias("members"), F.min("path").alias("first_path"), F.count_distinct("path").alias("files")).filter("members > 1")
    return classes.groupBy("members", "first_path", "files").agg(F.count("*").alias("classes"))


#: All pairs of a class; where they go on alike they are runs on one diagonal, so the shortest run of a class's pairs is what all its members share.
CLONES_SQL = """WITH words AS (SELECT doc_id AS path, flatten(list_transform(string_split(text, chr(10)), lambda x, i: list_transform(list_filter(string_split(x, ' '), lambda w: w <> ''), lambda w: {'w': w, 'l': i}))) AS t FROM documents),
files AS (SELECT path, list_transform(t, lambda x: x.w) AS k, list_transform(t, lambda x: x.l)::INT[] AS lines FROM words WHERE len(t) >= 50),
wins AS (SELECT path, i, md5_number(array_to_string(k[i + 1 : i + 50], ' ')) AS h FROM (SELECT path, k, unnest(generate_series(0, len(k) - 50))::INT AS i FROM files)),
many AS (SELECT path, i, h, count(*) OVER (PARTITION BY h) AS n FROM wins QUALIFY n > 1),
pairs AS (SELECT a.h, a.path AS p, a.i AS i, b.path AS q, b.i - a.i AS gap FROM many a JOIN many b USING (h) WHERE a.path <> b.path OR a.i <> b.i),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY p, q, gap ORDER BY i) AS island FROM pairs),
alike AS (SELECT *, max(i) OVER (PARTITION BY p, q, gap, island) - i + 50 AS n FROM runs),
lengths AS (SELECT h, min(n)::INT AS token_count FROM alike GROUP BY h),
places AS (SELECT h, path, token_count, list_sort(list(i)) AS spots FROM many JOIN lengths USING (h) GROUP BY ALL),
thinned AS (SELECT h, path, token_count, unnest(list_reduce(list_transform(spots, lambda x: [x]), lambda kept, x: CASE WHEN x[1] >= kept[-1] + token_count THEN list_concat(kept, x) ELSE kept END)) AS i FROM places),
shown AS (SELECT h, path, token_count, lines[i + 1] AS start_line, lines[i + token_count] AS end_line FROM thinned JOIN files USING (path)),
sized AS (SELECT h, count(*) AS n, max(end_line - start_line + 1) AS line_count, min((path, start_line)) AS first_at FROM shown GROUP BY h HAVING n >= 2 AND line_count >= 2),
found AS (SELECT * FROM shown JOIN sized USING (h)),
groups AS (SELECT *, dense_rank() OVER (ORDER BY line_count DESC, token_count DESC, first_at, h) AS r FROM found),
lost AS (SELECT r FROM groups g GROUP BY r HAVING bool_and(EXISTS (SELECT 1 FROM groups o WHERE o.path = g.path AND o.start_line <= g.start_line AND g.end_line <= o.end_line AND o.r < g.r))),
kept AS (SELECT * FROM groups WHERE r NOT IN (SELECT r FROM lost))"""


@query(CLONES_SQL + " SELECT path, start_line, end_line, token_count, line_count FROM kept")
def clone_groups(spark, sf_dir):
    """Duplicate blocks of documents, without the groups' names, which are hashes."""
    return clones.clone_groups(_token_files(spark, sf_dir), 50, 2).select("path", "start_line", "end_line", "token_count", "line_count")


@query(
    CLONES_SQL
    + """, sets AS (SELECT r, list_sort(list(DISTINCT path)) AS files, any_value(line_count) AS line_count FROM kept GROUP BY r)
SELECT files, count(*) AS group_count, sum(line_count)::BIGINT AS total_lines, CASE WHEN sum(line_count) >= 50 THEN 'Move the shared code to a module of its own' ELSE 'Move the shared code to a helper' END AS suggestion FROM sets GROUP BY files HAVING count(*) > 1"""
)
def clone_families(spark, sf_dir):
    return clones.families(clones.clone_groups(_token_files(spark, sf_dir), 50, 2))


@query(
    """WITH gs AS (SELECT l_orderkey AS g, list_sort(list(DISTINCT p_brand)) AS files, max(l_linenumber)::INT * 9 AS line_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT files, count(*) AS group_count, sum(line_count)::BIGINT AS total_lines, CASE WHEN sum(line_count) >= 50 THEN 'Move the shared code to a module of its own' ELSE 'Move the shared code to a helper' END AS suggestion FROM gs GROUP BY files HAVING count(*) > 1"""
)
def family_sets(spark, sf_dir):
    """Orders as groups, keyed by the set of brands of their items."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), "l_partkey", "l_linenumber").join(part, "l_partkey")
    sizes = rows.groupBy("group_id").agg((F.max("l_linenumber") * 9).cast("int").alias("line_count"))
    return clones.families(rows.select("group_id", "path").join(sizes, "group_id"))


# --- line-oriented text ---


def _order_lines(spark, sf_dir, header, body, source):
    """A text a source: each order gives a header line, each of its items a line below."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = line.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    heads = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate").select(source.alias("source"), (F.col("k") * 100_000_000).alias("line_no"), header.alias("value"))
    place = F.col("k") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.row_number().over(Window.partitionBy("k", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    return heads.unionByName(item.select(source.alias("source"), place.alias("line_no"), body.alias("value")))


@query(
    """SELECT 's' || (l_orderkey % 50) AS source, 'c' || o_orderkey AS "commit", floor(epoch(o_orderdate))::BIGINT AS ts, 'src/P' || l_partkey || '.java' AS path, l_suppkey AS added, l_quantity::BIGINT AS deleted
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 5 <> 0 AND l_suppkey % 9 <> 0"""
)
def log_parse(spark, sf_dir):
    header = F.concat(F.lit("COMMIT c"), F.col("k").cast("string"), F.lit(" "), epoch(F.col("o_orderdate")).cast("string"))
    added = F.when(F.col("l_suppkey") % 9 == 0, "-").otherwise(F.col("l_suppkey").cast("string"))
    body = F.concat_ws("\t", added, F.col("l_quantity").cast("long").cast("string"), F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, ".xml").otherwise(".java")))
    return textlog.commit_log(_order_lines(spark, sf_dir, header, body, F.concat(F.lit("s"), (F.col("k") % 50).cast("string"))))


@query(
    """SELECT 's' || (l_orderkey % 50) AS source, 'src/O' || l_orderkey || '.java' AS path, l_partkey::INT AS start, (l_partkey + l_quantity % 4 - 1)::INT AS "end", l_orderkey % 3 = 0 AS is_new
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity % 4 > 0"""
)
def diff_parse(spark, sf_dir):
    """Several lines a header: the diff line, the mode, the target; then a hunk an item."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("src/O"), F.col("k").cast("string"), F.lit(".java"))
    heads = orders.select(F.col("o_orderkey").alias("k")).select(F.concat(F.lit("s"), (F.col("k") % 50).cast("string")).alias("source"), "k", F.posexplode(F.array(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.when(F.col("k") % 3 == 0, "new file mode 100644").otherwise("index 1..2 100644"), F.concat(F.lit("+++ b/"), path))).alias("i", "value"))
    heads = heads.select("source", (F.col("k") * 100_000_000 + F.col("i")).alias("line_no"), "value")
    item = line.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    n = (F.col("l_quantity") % 4).cast("long")
    hunk = F.concat(F.lit("@@ -1 +"), F.col("l_partkey").cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" @@"))
    place = F.col("k") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.row_number().over(Window.partitionBy("k", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    hunks = item.select(F.concat(F.lit("s"), (F.col("k") % 50).cast("string")).alias("source"), place.alias("line_no"), hunk.alias("value"))
    return textlog.diff_ranges(heads.unionByName(hunks))


DEPS_SQL = "SELECT 's' || (l_orderkey % 50) AS source, CASE WHEN l_orderkey % 2 = 0 THEN 'unused' ELSE 'undeclared' END AS kind, 'g' || (l_partkey % 40) || ':a' || (l_suppkey % 9) AS coord FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


@query(DEPS_SQL)
def deps_parse(spark, sf_dir):
    header = F.when(F.col("k") % 2 == 0, "[WARNING] Unused declared dependencies found:").otherwise("[WARNING] Used undeclared dependencies found:")
    body = F.concat(F.lit("[WARNING]    g"), (F.col("l_partkey") % 40).cast("string"), F.lit(":a"), (F.col("l_suppkey") % 9).cast("string"), F.lit(":jar:1.0:compile"))
    return textlog.dependency_report(_order_lines(spark, sf_dir, header, body, F.concat(F.lit("s"), (F.col("k") % 50).cast("string")))).select("source", "kind", "coord")


@query("SELECT event_type AS kind, user_id % 50 AS coord, min(event_id) AS line_no FROM events GROUP BY ALL")
def dedupe_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 50).alias("coord"), F.col("event_id").alias("line_no"))
    return ranking.first_seen(rows, ["kind", "coord"], "line_no")


# --- scalars ---


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' , ,' || p_name || ',', ','), lambda x: lower(trim(x))), lambda x: x <> '') AS entries FROM part")
def option_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", option_entries(F.concat("p_type", F.lit(" , ,"), "p_name", F.lit(","))).alias("entries"))


@query("SELECT p_partkey, replace(replace(lower(trim(' ' || p_type || '_x ')), ' ', '-'), '_', '-') AS topic FROM part")
def topic_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", topic_key(F.concat(F.lit(" "), "p_type", F.lit("_x "))).alias("topic"))


@query("SELECT p_partkey, regexp_full_match(CASE p_partkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'HEAD~' WHEN 2 THEN '' ELSE 'a;b' END || p_brand, '[A-Za-z0-9._/@{}~^ ][A-Za-z0-9._/@{}~^ -]*') AS ok FROM part")
def ref_validate(spark, sf_dir):
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", valid_ref(F.concat(F.when(k == 0, "-").when(k == 1, "HEAD~").when(k == 2, "").otherwise("a;b"), "p_brand")).alias("ok"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS rel, list_last(string_split(url, '/')) AS name FROM pages")
def relative_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", relative(F.col("url"), "https:/").alias("rel"), base_name(F.col("url")).alias("name"))


@query("SELECT * FROM (VALUES ('complexity', 'Complex functions'), ('unused-exports', 'Unused exports'), ('clone-families', 'Clone families'), ('deps', 'Dependencies')) AS t(id, name)")
def topic_lookup(spark, sf_dir):
    return find(topics(spark), " Cognitive ").unionByName(find(topics(spark), "unused_exports")).unionByName(find(topics(spark), "Families")).unionByName(find(topics(spark), "maven")).unionByName(find(topics(spark), "nonsense")).select("id", "name")


@query(
    f"""WITH RECURSIVE {FUNCTIONS_SQL}, {SCC_SQL}, t AS (SELECT 'complexity' AS target, (SELECT count(*) FROM violations) AS n UNION ALL SELECT 'large-functions', (SELECT count(*) FROM fns WHERE line_count > 60) UNION ALL SELECT 'circular', (SELECT count(DISTINCT scc) FROM scc))
SELECT target, n, n > 0 AS failed, CASE WHEN n > 0 THEN n || CASE target WHEN 'complexity' THEN ' complex function' WHEN 'circular' THEN ' circular dependency' ELSE ' large function' END || CASE WHEN n > 1 THEN 's' ELSE '' END || CASE target WHEN 'complexity' THEN ' above the limit' ELSE '' END END AS message FROM t"""
)
def gate_table(spark, sf_dir):
    return gates(spark, ["complexity", "large-functions", "circular", "hotspots", "nonsense"], {"complexity": complexity_violations(spark, sf_dir), "large-functions": large_functions(spark, sf_dir), "circular": scc_cycles(spark, sf_dir)})


# --- Java text made of part rows ---


def _java(spark, sf_dir):
    """A class a part: nested conditions, cases, an import and an export, by its numbers."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    deep = (F.col("p_size") % 6).cast("int")
    body = F.concat(F.repeat(F.lit("if (a > 0 && b) {\n"), deep), F.lit("go();\n"), F.repeat(F.lit("}\n"), deep))
    text = F.concat(F.lit("package b"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit(";\nimport q.T"), (F.col("p_partkey") % 7).cast("string"), F.lit(";\nimport w.*;\npublic class C"), k, F.lit(" {\n  public int m"), k, F.lit("(int a, boolean b) {\n"), body, F.lit("switch (a) { case 1: break; default: break; }\n return 0; }\n  private void x() {}\n}\n"))
    return part.select(F.concat(F.lit("src/C"), k, F.lit(".java")).alias("path"), text.alias("content"))


@query(
    """SELECT 'src/C' || p_partkey || '.java' AS path, 'm' || p_partkey AS name, (2 + 2 * (p_size % 6))::INT AS cyclomatic,
((p_size % 6) * (p_size % 6 + 1) // 2 + p_size % 6 + 1)::INT AS cognitive, (2 * (p_size % 6) + 4)::INT AS line_count, 2::INT AS param_count FROM part"""
)
def java_metrics(spark, sf_dir):
    found = parse_sources(_java(spark, sf_dir)).select("path", F.explode("functions").alias("f")).select("path", "f.*")
    return found.filter("name <> 'x'").select("path", "name", "cyclomatic", "cognitive", "line_count", "param_count")


@query("SELECT 'src/C' || p_partkey || '.java' AS path, 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS package, ['q.T' || (p_partkey % 7)] AS imports, ['w'] AS wildcard_imports, 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.C' || p_partkey AS fqn, 'm' || p_partkey AS export FROM part")
def java_names(spark, sf_dir):
    found = parse_sources(_java(spark, sf_dir))
    return found.select("path", "package", "imports", "wildcard_imports", F.col("types")[0]["fqn"].alias("fqn"), F.col("exports")[0]["name"].alias("export"))


@query("SELECT p_size, count(*) AS n, count(*) || ' part' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS label FROM part GROUP BY p_size")
def plural_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", "n", counted(F.col("n"), "part").alias("label"))


@query("SELECT 'src/C' || p_partkey || '.java' AS path, (2 + 2 * (p_size % 6) + 1) / (11 + 2 * (p_size % 6))::DOUBLE AS density, ((p_size % 6) * (p_size % 6 + 1) // 2 + p_size % 6 + 1)::INT AS max_cognitive, 2 AS function_count, 1 AS export_count, (11 + 2 * (p_size % 6))::INT AS lines, true AS is_public, false AS is_root FROM part")
def java_facts(spark, sf_dir):
    """Facts of a file over its functions."""
    return graph.file_facts(parse_sources(_java(spark, sf_dir)))


@query("SELECT 'src/C' || p_partkey || '.java' AS path, ['C' || p_partkey, 'T' || (p_partkey % 7), 'a', 'b', 'go', 'm' || p_partkey, 'q', 'w', 'x'] AS names FROM part")
def java_used_names(spark, sf_dir):
    """All names of a file but its package's."""
    found = parse_sources(_java(spark, sf_dir))
    return found.select("path", F.array_sort(F.array_except("used_names", F.array("package"))).alias("names"))


@query(
    """WITH t AS (SELECT 'src/C' || p_partkey || '.java' AS path, (p_size % 6)::INT AS d, ['package', 'id:b' || regexp_replace(p_brand, '[^0-9]', '', 'g'), ';'] AS head, p_partkey AS k FROM part)
SELECT path, 59 + 10 * d AS tokens, head, 10 + 2 * d AS last_line FROM t"""
)
def java_tokens(spark, sf_dir):
    """What clone detection sees: how many tokens, the first ones, and the line of the last."""
    found = tokenize_sources(_java(spark, sf_dir))
    return found.select("path", F.size("keys").alias("tokens"), F.slice("keys", 1, 3).alias("head"), F.element_at("lines", -1).alias("last_line"))
