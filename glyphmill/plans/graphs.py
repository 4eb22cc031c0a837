"""Queries on graphs and unused declarations, on the driver's tables.

The dependency graph runs region, nation, customer, order, part. Declarations are customers and parts,
references are orders and line items, occurrences are events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, unused


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "p", "p_partkey")]
    return reduce(DataFrame.unionByName, [_t(spark, d, t).select(_id(p, k).alias("id"), F.lit(t).alias("kind")) for t, p, k in parts])


def edges(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"))
    customer = _t(spark, d, "customer").select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst"))
    orders = _t(spark, d, "orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst"))
    items = _t(spark, d, "lineitem").select(_id("o", "l_orderkey").alias("src"), _id("p", "l_partkey").alias("dst"))
    return reduce(DataFrame.unionByName, [nation, customer, orders, items])


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "region").where("r_regionkey in (0, 2)").select(_id("r", "r_regionkey").alias("id"))


def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(edges(spark, d), _roots(spark, d)).select("id", F.col("depth").cast("long").alias("depth"))


def unreachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreachable(nodes(spark, d), edges(spark, d), _roots(spark, d))


def cyclic_reach(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers that share line items, from one part on: a graph with cycles."""
    items = _t(spark, d, "lineitem")
    p, s = _id("p", "l_partkey"), _id("s", "l_suppkey")
    both = items.select(p.alias("src"), s.alias("dst")).unionByName(items.select(s.alias("src"), p.alias("dst")))
    return graph.reachable(both, items.select(F.min("l_partkey").alias("k")).select(_id("p", "k").alias("id"))).select("id")


def components(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "lineitem")
    return graph.components(items.select(F.col("l_partkey").alias("u"), (-F.col("l_orderkey") - 1).alias("v")))


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from roots to all that they reach."""
    found = graph.paths(edges(spark, d), _roots(spark, d))
    return found.select("id", F.array_join("path", ">").alias("path"))


def report(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach_report(nodes(spark, d), edges(spark, d), _roots(spark, d))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_statistics(nodes(spark, d), edges(spark, d))


def affected(spark: SparkSession, d: str) -> DataFrame:
    changed = _t(spark, d, "part").where("p_size = 50").select(_id("p", "p_partkey").alias("id"))
    return graph.affected(edges(spark, d), changed)


def declarations(spark: SparkSession, d: str) -> DataFrame:
    """Customers as declarations; every kind, access level, attribute and name form comes up."""
    k = F.col("c_custkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    name = F.when(k % 97 == 0, "main").when(k % 89 == 0, "body").when(k % 83 == 0, "_").when(k % 79 == 0, F.concat(F.lit("test"), k.cast("string"))).when(k % 73 == 0, "CodingKeys").when(k % 71 == 0, F.concat(F.lit("`"), k.cast("string"), F.lit("`"))).when(
        k % 67 == 0, F.concat("c_mktsegment", F.lit("Tests"))
    ).otherwise(F.concat(F.lit("C"), k.cast("string")))
    return _t(spark, d, "customer").select(
        k.alias("id"), name.alias("name"), pick(8, "function", "variable", "method", "class", "enum", "constant", "parameter", "import").alias("kind"),
        pick(6, "private", "fileprivate", "internal", "package", "public", "open").alias("access"),
        F.concat(F.lit("Sources/n"), F.col("c_nationkey").cast("string"), F.lit("/f"), (k % 40).cast("string"), F.lit(".swift")).alias("file"),
        ((k % 500) * 10).cast("int").alias("line"), ((k % 500) * 10 + k % 23).cast("int").alias("end_line"),
        F.when(k % 61 == 0, F.array(F.lit("objc"))).when(k % 59 == 0, F.array(F.lit("IBAction"), F.lit("x"))).when(k % 53 == 0, F.array(F.lit("_cdecl"))).when(k % 47 == 0, F.array(F.lit("main"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
        F.when(k % 43 == 0, F.lit("see @_silgen_name")).alias("documentation"), F.when(k % 41 == 0, F.array(F.lit("static"))).alias("modifiers"),
        F.when(k % 37 == 0, F.array(F.lit("View"))).when(k % 31 == 0, F.array(F.lit("PreviewProvider"))).alias("conformances"), F.when(k % 29 == 0, F.array(F.lit("State"))).alias("wrappers"),
        F.when(k % 19 == 0, F.array(F.lit("unused-functions"))).when(k % 17 == 0, F.array(F.lit("all"))).alias("ignore_directives"),
    )


def references(spark: SparkSession, d: str) -> DataFrame:
    """Orders as references to customers."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("identifier"), F.concat(F.lit("Sources/n"), (k % 25).cast("string"), F.lit("/f"), (k % 40).cast("string"), F.lit(".swift")).alias("file"),
        (k % 5000).cast("int").alias("line"), F.when(k % 3 == 0, "read").when(k % 3 == 1, "write").otherwise("call").alias("context"), F.when(k % 5 == 0, F.lit("C1")).alias("qualifier"),
    )


def root_reasons(spark: SparkSession, d: str) -> DataFrame:
    return declarations(spark, d).select("id", graph.root_reason(public=False).alias("reason"))


def range_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.reference_edges(declarations(spark, d), references(spark, d))


def unused_by_name(spark: SparkSession, d: str) -> DataFrame:
    found = unused.unused_by_name(declarations(spark, d), references(spark, d)).where(unused.should_check(ignored=["^C1[0-9]$"]))
    why = unused.reason(F.col("kind"), F.lit(0), F.lit(0))
    return found.select("id", unused.confidence(F.col("access")).alias("confidence"), why.alias("reason"), unused.suggestion(why, F.col("kind"), F.col("name")).alias("suggestion"))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    return declarations(spark, d).where(~unused.excluded(["**/n1/**"], ["^C2"])).select("id")


def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    return unused.unused_imports(declarations(spark, d).where("kind = 'import'"), references(spark, d)).select("id", "confidence")


def unused_by_reach(spark: SparkSession, d: str) -> DataFrame:
    declared = declarations(spark, d)
    links = range_edges(spark, d)
    roots = declared.where(graph.root_reason(public=False).isNotNull()).select("id")
    return unused.unused_by_reach(declared, links, roots).select("id", "confidence")


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    roles = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 4).when(F.col("event_type") == "click", 4 + 8).otherwise(1)
    return _t(spark, d, "events").select(F.col("user_id").alias("usr"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file"), roles.alias("roles"))


def symbol_usage(spark: SparkSession, d: str) -> DataFrame:
    return unused.symbol_usage(_occurrences(spark, d), 2, 4)


def name_usage(spark: SparkSession, d: str) -> DataFrame:
    return unused.name_usage(declarations(spark, d), references(spark, d)).select("id", "reason")


def merged(spark: SparkSession, d: str) -> DataFrame:
    declared = declarations(spark, d)
    index = declared.where("id % 3 = 0").select("file", "line", "name", F.lit("index").alias("found_by"))
    syntax = declared.where("id % 2 = 0").select("file", "line", "name", F.lit("syntax").alias("found_by"))
    return unused.merged(index.distinct(), syntax.distinct(), ["file", "line", "name"])


def summary(spark: SparkSession, d: str) -> DataFrame:
    return unused.summary(declarations(spark, d).withColumn("confidence", unused.confidence(F.col("access"))))


def without_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = _t(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("calls"))
    return unused.without_calls(declarations(spark, d).select("id"), calls)


QUERIES = {
    "g7_reachable": reachable, "g7_unreachable": unreachable, "g8_cyclic_reach": cyclic_reach, "m14_components": components, "g9_paths": shortest_paths, "g10_report": report, "g11_stats": statistics,
    "i2_affected": affected, "g2_roots": root_reasons, "g3_range_edges": range_edges, "u1_unreferenced": unused_by_name, "f2_excluded": filtered, "u4_imports": unused_imports,
    "u5_unreachable": unused_by_reach, "u7_usage": symbol_usage, "u9_self_ref": name_usage, "u6_hybrid_merge": merged, "u11_summary": summary, "u13_without_calls": without_calls,
}

_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'orders' FROM orders UNION ALL SELECT 'p' || p_partkey, 'part' FROM part)"""
_EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""
_REACH = "reach AS (SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey IN (0, 2) UNION SELECT dst FROM reach JOIN edges ON id = src)"
_DECL = """decl AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN 'main' WHEN c_custkey % 89 = 0 THEN 'body' WHEN c_custkey % 83 = 0 THEN '_' WHEN c_custkey % 79 = 0 THEN 'test' || c_custkey
WHEN c_custkey % 73 = 0 THEN 'CodingKeys' WHEN c_custkey % 71 = 0 THEN '`' || c_custkey || '`' WHEN c_custkey % 67 = 0 THEN c_mktsegment || 'Tests' ELSE 'C' || c_custkey END AS name,
['function', 'variable', 'method', 'class', 'enum', 'constant', 'parameter', 'import'][c_custkey % 8 + 1] AS kind, ['private', 'fileprivate', 'internal', 'package', 'public', 'open'][c_custkey % 6 + 1] AS access,
'Sources/n' || c_nationkey || '/f' || (c_custkey % 40) || '.swift' AS file, CAST((c_custkey % 500) * 10 AS INT) AS line, CAST((c_custkey % 500) * 10 + c_custkey % 23 AS INT) AS end_line, c_custkey AS k,
CASE WHEN c_custkey % 61 = 0 THEN ['objc'] WHEN c_custkey % 59 = 0 THEN ['IBAction', 'x'] WHEN c_custkey % 53 = 0 THEN ['_cdecl'] WHEN c_custkey % 47 = 0 THEN ['main'] ELSE [] END AS attributes FROM customer)"""
_REFS = """refs AS (SELECT 'C' || o_custkey AS identifier, 'Sources/n' || (o_orderkey % 25) || '/f' || (o_orderkey % 40) || '.swift' AS file, CAST(o_orderkey % 5000 AS INT) AS line,
CASE WHEN o_orderkey % 3 = 0 THEN 'read' WHEN o_orderkey % 3 = 1 THEN 'write' ELSE 'call' END AS context, CASE WHEN o_orderkey % 5 = 0 THEN 'C1' END AS qualifier FROM orders)"""
_REASON = """CASE WHEN list_contains(attributes, 'main') THEN 'mainAttribute' WHEN name = 'main' AND kind = 'function' THEN 'mainFunction' WHEN name = 'main' AND k % 41 = 0 THEN 'staticMain'
WHEN list_contains(attributes, 'objc') THEN 'objcExposed' WHEN list_contains(attributes, 'IBAction') THEN 'interfaceBuilder' WHEN starts_with(name, 'test') AND kind IN ('function', 'method') THEN 'testMethod'
WHEN name = 'CodingKeys' AND kind = 'enum' THEN 'codableRequirement' WHEN k % 43 = 0 THEN 'silgenName' WHEN list_contains(attributes, '_cdecl') THEN 'cdecl' WHEN k % 37 = 0 THEN 'swiftUIView'
WHEN k % 31 = 0 THEN 'swiftUIPreview' WHEN k % 29 = 0 THEN 'swiftUIPropertyWrapper' WHEN name = 'body' AND kind = 'variable' THEN 'viewBody' END"""
_LINKS = "links AS (SELECT DISTINCT a.id AS src, b.id AS dst, r.context AS kind FROM decl a JOIN refs r ON r.file = a.file AND r.line BETWEEN a.line AND a.end_line JOIN decl b ON b.name = r.identifier WHERE a.id <> b.id)"
_CONF = "CASE WHEN access IN ('private', 'fileprivate') THEN 'high' WHEN access IN ('internal', 'package') THEN 'medium' ELSE 'low' END"

ORACLES = {
    "g7_reachable": f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS depth FROM region WHERE r_regionkey IN (0, 2) UNION SELECT dst, depth + 1 FROM reach JOIN edges ON id = src) SELECT id, min(depth) AS depth FROM reach GROUP BY id",
    "g7_unreachable": f"WITH RECURSIVE {_NODES}, {_EDGES}, {_REACH} SELECT id, kind FROM nodes WHERE id NOT IN (SELECT id FROM reach)",
    "g8_cyclic_reach": """WITH RECURSIVE i AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_partkey AS k FROM lineitem), e AS (SELECT p AS src, s AS dst FROM i UNION SELECT s, p FROM i),
r AS (SELECT 'p' || min(k) AS id FROM i UNION SELECT dst FROM r JOIN e ON id = src) SELECT id FROM r""",
    "m14_components": """WITH RECURSIVE e AS (SELECT l_partkey AS u, -l_orderkey - 1 AS v FROM lineitem UNION SELECT -l_orderkey - 1, l_partkey FROM lineitem),
r(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, min(r.component) FROM r JOIN e ON e.u = r.node JOIN recurring.r AS x ON x.node = e.v WHERE r.component < x.component GROUP BY e.v)
SELECT node, component FROM r""",
    "g9_paths": f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM edges),
p AS (SELECT 'r' || r_regionkey AS id, ['r' || r_regionkey] AS path FROM region WHERE r_regionkey IN (0, 2) UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN f ON id = src)
SELECT id, array_to_string(min(path), '>') AS path FROM p GROUP BY id""",
    "g10_report": f"""WITH RECURSIVE {_NODES}, {_EDGES}, {_REACH}, m AS (SELECT kind, id IN (SELECT id FROM reach) AS hit FROM nodes)
SELECT kind, count(*) AS nodes, count(*) FILTER (hit) AS reachable, count(*) FILTER (NOT hit) AS unreachable, round(count(*) FILTER (hit) * 100.0 / count(*), 6)::DOUBLE AS percent FROM m GROUP BY kind""",
    "g11_stats": f"""WITH {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes), 9) AS mean_degree,
(SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY src)) AS max_out, (SELECT max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS max_in""",
    "i2_affected": f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size = 50 UNION SELECT src FROM r JOIN edges ON id = dst) SELECT id FROM r",
    "g2_roots": f"WITH {_DECL} SELECT id, {_REASON} AS reason FROM decl",
    "g3_range_edges": f"WITH {_DECL}, {_REFS}, {_LINKS} SELECT src, dst, kind FROM links",
    "u1_unreferenced": f"""WITH {_DECL}, {_REFS}, x AS (SELECT *, CASE WHEN kind = 'parameter' THEN 'parameterUnused' ELSE 'neverReferenced' END AS reason FROM decl WHERE name NOT IN (SELECT identifier FROM refs) AND name <> '_' AND kind <> 'import'
AND access NOT IN ('public', 'open') AND NOT list_contains(attributes, 'main') AND NOT regexp_matches(name, '^C1[0-9]$'))
SELECT id, {_CONF} AS confidence, reason, CASE WHEN reason = 'parameterUnused' THEN 'Parameter ''' || name || ''' is never used; consider renaming to ''_''' ELSE 'Consider removing unused ' || kind || ' ''' || name || '''' END AS suggestion FROM x""",
    "f2_excluded": f"""WITH {_DECL} SELECT id FROM decl WHERE name <> '_' AND NOT (k % 19 = 0 AND kind = 'function') AND NOT (k % 17 = 0 AND k % 19 <> 0) AND kind <> 'import' AND NOT starts_with(name, '`') AND NOT ends_with(name, 'Tests')
AND NOT regexp_matches(file, '/n1/') AND NOT starts_with(name, 'C2')""",
    "u4_imports": f"WITH {_DECL}, {_REFS} SELECT id, 'low' AS confidence FROM decl WHERE kind = 'import' AND name NOT IN (SELECT identifier FROM refs UNION SELECT qualifier FROM refs WHERE qualifier IS NOT NULL)",
    "u5_unreachable": f"""WITH RECURSIVE {_DECL}, {_REFS}, {_LINKS}, r AS (SELECT id FROM (SELECT id, {_REASON} AS reason FROM decl) WHERE reason IS NOT NULL UNION SELECT dst FROM r JOIN links ON id = src)
SELECT id, {_CONF} AS confidence FROM decl WHERE id NOT IN (SELECT id FROM r) AND access NOT IN ('public', 'open')""",
    "u7_usage": """WITH o AS (SELECT user_id AS usr, 'f' || (event_id % 7) AS file, CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 4 WHEN 'click' THEN 12 ELSE 1 END AS roles FROM events),
g AS (SELECT usr, count(*) FILTER (roles & 2 <> 0) AS definitions, count(*) FILTER (roles & 4 <> 0) AS uses, list(file) FILTER (roles & 2 <> 0) AS d, list(file) FILTER (roles & 4 <> 0) AS r FROM o GROUP BY usr)
SELECT usr, definitions, uses, uses > 0 AND len(list_filter(coalesce(r, []), lambda f: NOT list_contains(coalesce(d, []), f))) = 0 AS only_self FROM g""",
    "u9_self_ref": f"""WITH {_DECL}, {_REFS}, c AS (SELECT identifier, count(*) AS n, min(file) AS f FROM refs GROUP BY identifier)
SELECT id, reason FROM (SELECT id, CASE WHEN n IS NULL THEN 'neverReferenced' WHEN n = 1 AND f = file THEN 'onlySelfReferenced' END AS reason FROM decl LEFT JOIN c ON name = identifier) WHERE reason IS NOT NULL""",
    "u6_hybrid_merge": f"""WITH {_DECL}, i AS (SELECT DISTINCT file, line, name FROM decl WHERE id % 3 = 0), s AS (SELECT DISTINCT file, line, name FROM decl WHERE id % 2 = 0)
SELECT file, line, name, CASE WHEN i.name IS NULL THEN 'syntax' ELSE 'index' END AS found_by FROM (SELECT * FROM i UNION SELECT * FROM s) LEFT JOIN i USING (file, line, name)""".replace("i.name IS NULL", "h IS NULL").replace("LEFT JOIN i USING", "LEFT JOIN (SELECT *, 1 AS h FROM i) USING"),
    "u11_summary": f"""WITH {_DECL}, x AS (SELECT kind, {_CONF} AS c FROM decl) SELECT kind, count(*) FILTER (c = 'low') AS low, count(*) FILTER (c = 'medium') AS medium, count(*) FILTER (c = 'high') AS high, count(*) AS total FROM x GROUP BY kind""",
    "u13_without_calls": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
}
