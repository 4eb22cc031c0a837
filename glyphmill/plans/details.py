"""Queries on documentation comments, symbol identifiers, searches, snippets and merged diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow, graph, incremental, minhash, reports, symbols, unused
from . import graphs, lookups, similar


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documentation(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names and types as comments with fields in several forms."""
    size = F.col("p_size")
    fields = F.concat(
        F.lit("/**\n * "), "p_name", F.lit("\n * "), "p_type", F.when(size % 4 == 0, "").otherwise("\n *\n * further text"), F.lit("\n * - Parameter size: the size "), size.cast("string"),
        F.when(size % 3 == 0, F.concat(F.lit("\n * - Returns: "), "p_brand")).otherwise(""), F.lit("\n * - Note: first\n *   goes on\n * - Throws: never"), F.when(size % 5 == 0, "\n * - Note: second").otherwise(""), F.lit("\n * - other: value\n */"),
    )
    out = reports.documentation(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), fields.alias("comment")))
    return out.select("id", "summary", F.array_join("parameters", "|").alias("parameters"), "returns", "throws", F.array_join("notes", "|").alias("notes"))


def symbol_identifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    name = F.concat(F.lit("item"), k.cast("string"))
    usr = F.concat(F.lit("s:4main"), pick(5, "C", "V", "O", "P", "y"), F.char_length(name).cast("string"), name, pick(6, "vp", "fC", "cc", "FC", "", "Z"))
    usr = F.when(k % 50 == 0, F.concat(F.lit("c:objc(cs)"), name)).otherwise(usr)
    return _t(spark, d, "customer").select("c_custkey", symbols.decoded_usr(usr).alias("u")).select("c_custkey", "u.*")


def severities(spark: SparkSession, d: str) -> DataFrame:
    return graphs.declarations(spark, d).select("id", reports.severity(unused.confidence(F.col("access"))).alias("severity"))


def merged_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 9).cast("string")).alias("file"), F.col("event_id").alias("line"), (F.col("user_id") % 80).alias("col"), F.col("event_type").alias("message"))
    return incremental.merged(rows.where("message = 'error'"), rows.where("message = 'click'"))


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return symbols.search(graphs.declarations(spark, d), "c1", access="package", limit=50).select("id")


def type_edges(spark: SparkSession, d: str) -> DataFrame:
    typed = graphs.declarations(spark, d).withColumn("type", F.concat(F.lit("Array<C"), (F.col("id") + 1).cast("string"), F.lit(", Int>")))
    return graph.type_edges(typed)


def function_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a function of doc_id % 70 + 1 lines from its first line on."""
    docs = _t(spark, d, "documents")
    declared = docs.select(F.col("doc_id").alias("file"), F.lit("f").alias("name"), F.when(F.col("doc_id") % 9 == 0, "variable").otherwise("function").alias("kind"), F.lit(1).alias("line"), (F.col("doc_id") % 70 + 1).cast("int").alias("end_line"))
    out = symbols.function_snippets(declared, docs.select(F.col("doc_id").alias("file"), "text"))
    return out.select("file", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"), "tokens")


def file_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Of each file the declarations without imports and its first three references."""
    return symbols.file_analysis(graphs.declarations(spark, d), graphs.references(spark, d), most_references=3).select("file", "what", "name", "line")


def sequence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive documents' shingle sets: exact, and estimated by 256 minima (as correct within 0.2 or not)."""
    docs = similar.hashes(spark, d)
    both = docs.join(docs.select((F.col("id") - 1).alias("id"), F.col("hashes").alias("other")), "id")
    exact, estimated = (minhash.sequence_similarity(F.col("hashes"), F.col("other"), exact=x) for x in (True, False))
    return both.select("id", F.round(exact, 9).alias("similarity"), (F.abs(exact - estimated) < 0.2).alias("near"))


def symbols_report(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    matches = part.select(
        F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").alias("line"), F.col("p_size").alias("col"), F.lit("class").alias("kind"),
        F.concat(F.lit("P"), "p_partkey").alias("name"), F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).alias("generics"), F.lit("public").alias("access"),
        F.when(F.col("p_size") % 2 == 0, F.lit("make(of:)")).alias("selector"), F.when(F.col("p_size") % 5 == 0, F.array("p_type", "p_name")).alias("context"),
    )
    return reports.symbols_text(matches)


def usages_report(spark: SparkSession, d: str) -> DataFrame:
    kinds = symbols.usage_kind(F.col("roles"), 16, 8, 4)
    return reports.usages_text(lookups._occurrences(spark, d).select("file", "line", "col", kinds.alias("kind")))


def control_flow(spark: SparkSession, d: str) -> DataFrame:
    """Orders as functions: returned lines are ifs around a return, accepted ones empty loops, the others plain."""
    item = spark.read.parquet(f"{d}/lineitem.parquet")
    lines = item.groupBy(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("idx")).agg(F.min("l_returnflag").alias("flag"))
    block = F.concat(F.lit("b"), F.col("idx").cast("string"))
    kind = F.when(F.col("flag") == "R", "if").when(F.col("flag") == "A", "while").otherwise("plain")
    none = F.lit(None).cast("string")
    outer = lines.select("fn", block.alias("block"), none.alias("parent"), none.alias("slot"), F.col("idx").cast("int").alias("idx"), kind.alias("kind"))
    inner = outer.where("kind = 'if'").select("fn", F.concat("block", F.lit("r")).alias("block"), F.col("block").alias("parent"), F.lit("then").alias("slot"), F.lit(0).alias("idx"), F.lit("return").alias("kind"))
    return dataflow.control_flow(outer.unionByName(inner))


QUERIES = {
    "z5_symbols_text": symbols_report, "z5_usages_text": usages_report, "d1_control_flow": control_flow,
    "x18_documentation": documentation, "x16_usr": symbol_identifiers, "z6_severity": severities, "n3_merge": merged_diagnostics, "s14_search": symbol_search, "g4_type_edges": type_edges,
    "a13_snippets": function_snippets, "r2_file_analysis": file_analysis, "m16_pair_similarity": sequence_similarity,
}

_ACCESS = "['private', 'fileprivate', 'internal', 'package', 'public', 'open']"

ORACLES = {
    "z5_symbols_text": """WITH m AS (SELECT 'f' || (p_partkey % 50) AS file, p_partkey, p_size, '  ' || p_partkey || ':' || p_size || ' class P' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '<' || p_brand || ',' || p_type || '>' ELSE '' END || ' public'
|| CASE WHEN p_size % 2 = 0 THEN ' make(of:)' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN chr(10) || '    ' || p_type || chr(10) || '    ' || p_name ELSE '' END AS text FROM part)
SELECT file, string_agg(text, chr(10) ORDER BY p_partkey, p_size) AS report FROM m GROUP BY file""",
    "z5_usages_text": f"""WITH {lookups._O}, k AS (SELECT file, line, col, CASE WHEN roles & 16 <> 0 THEN 'call' WHEN roles & 8 <> 0 THEN 'write' WHEN roles & 4 <> 0 THEN 'read' ELSE 'reference' END AS kind FROM occ),
g AS (SELECT file, list(line || ':' || col || '(' || kind[1:3] || ')' ORDER BY line, col, kind) AS items FROM k GROUP BY file)
SELECT file, list_reduce(list_prepend('  ', items), lambda a, x: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + length(x) > 100 THEN a || chr(10) || '  ' ELSE a END || x || ' ') AS report FROM g""",
    "d1_control_flow": """WITH l AS (SELECT l_orderkey AS fn, l_linenumber AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
b AS (SELECT fn, n, flag, 'b' || n AS src, coalesce('b' || lead(n) OVER (PARTITION BY fn ORDER BY n), 'exit') AS dst FROM l)
SELECT fn, src, dst FROM b UNION ALL SELECT fn, src, src FROM b WHERE flag = 'A' UNION ALL SELECT fn, src, src || 'r' FROM b WHERE flag = 'R'
UNION ALL SELECT fn, src || 'r', 'exit' FROM b WHERE flag = 'R' UNION ALL SELECT fn, 'entry', 'b' || min(n) FROM l GROUP BY fn""",
    "x18_documentation": """SELECT p_partkey AS id, p_name || ' ' || p_type AS summary, 'size: the size ' || p_size || '|other: value' AS parameters, CASE WHEN p_size % 3 = 0 THEN p_brand END AS returns, 'never' AS throws,
CASE WHEN p_size % 5 = 0 THEN 'first goes on|second ' ELSE 'first goes on ' END AS notes FROM part""",
    "x16_usr": """WITH u AS (SELECT c_custkey, c_custkey % 50 = 0 AS c, 'item' || c_custkey AS n, ['C', 'V', 'O', 'P', 'y'][c_custkey % 5 + 1] AS m, c_custkey % 6 AS e FROM customer)
SELECT c_custkey, CASE WHEN c THEN 'clang' ELSE 'swift' END AS schema, CASE WHEN NOT c THEN 'main' END AS context, CASE WHEN c THEN 'c:objc(cs)' || n ELSE n END AS name,
CASE WHEN c THEN NULL WHEN e = 0 THEN 'property' WHEN e = 1 THEN 'method' WHEN e = 2 THEN 'initializer' WHEN e = 3 THEN 'function' ELSE ['type', 'struct', 'enum', 'protocol', 'unknown'][c_custkey % 5 + 1] END AS kind, NOT c AND e = 5 AS static FROM u""",
    "z6_severity": "SELECT c_custkey AS id, ['warning', 'warning', 'information', 'information', 'hint', 'hint'][c_custkey % 6 + 1] AS severity FROM customer",
    "n3_merge": "SELECT 'f' || (user_id % 9) AS file, event_id AS line, user_id % 80 AS col, event_type AS message FROM events WHERE event_type IN ('error', 'click')",
    "s14_search": f"WITH {graphs._DECL} SELECT id FROM decl WHERE contains(lower(name), 'c1') AND list_position({_ACCESS}, access) >= 4 ORDER BY file, line, name LIMIT 50",
    "g4_type_edges": f"WITH {graphs._DECL} SELECT a.id AS src, b.id AS dst, 'typeReference' AS kind FROM decl a JOIN decl b ON b.name = 'C' || (a.id + 1)",
    "a13_snippets": """WITH s AS (SELECT doc_id AS file, array_to_string(string_split(text, chr(10))[1:doc_id % 70 + 1], chr(10)) AS s FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 70 + 1 BETWEEN 5 AND 60 AND text IS NOT NULL)
SELECT file, md5(s) AS snippet_md5, greatest(1, length(s) // 4) AS tokens FROM s""",
    "r2_file_analysis": f"""WITH {graphs._DECL}, {graphs._REFS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, identifier) AS n FROM refs)
SELECT file, 'declaration' AS what, name, line FROM decl WHERE kind <> 'import' UNION ALL SELECT file, 'reference', identifier, line FROM r WHERE n <= 3""",
    "m16_pair_similarity": f"WITH {similar._H} SELECT a.id, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 9) AS similarity, true AS near FROM h a JOIN h b ON b.id = a.id + 1",
}
