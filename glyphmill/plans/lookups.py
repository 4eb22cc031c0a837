"""Queries on symbols, changes and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, symbols


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scopes(spark: SparkSession, d: str) -> DataFrame:
    region = _t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("scope_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nation = _t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("scope_id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    return region.unionByName(nation)


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as declarations inside nations inside regions."""
    chains = symbols.chains(_scopes(spark, d))
    k = F.col("s_suppkey")
    supplier = _t(spark, d, "supplier").select(
        k.alias("id"), F.concat(F.lit("fetch"), (k % 7).cast("string")).alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("scope_id"), F.lit("method").alias("kind"),
        F.when(k % 3 == 0, F.array(F.lit("id"), F.lit(None).cast("string"))).when(k % 3 == 1, F.array(F.lit("id"))).alias("labels"), F.concat(F.lit("s:"), k.cast("string")).alias("usr"),
        F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"), (k / 5).cast("int").alias("line"), F.lit(1).alias("col"),
    )
    return supplier.join(chains, "scope_id")


def by_name(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find(_symbols(spark, d), "fetch3").select("id", "file", "line")


def qualified(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers named as the first one, in its nation."""
    nation = _t(spark, d, "supplier").where("s_suppkey = 1").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    home = nation.join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").first()
    return symbols.find(_symbols(spark, d), f"{home.r_name}.{home.n_name}.fetch1").select("id")


def selector(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find(_symbols(spark, d), "fetch2(id:_:)").select("id")


def regex(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find(_symbols(spark, d), "/fetch[1-4]/", limit=50).select("id")


def batch(spark: SparkSession, d: str) -> DataFrame:
    queries = {"a": "fetch1", "b": "/fetch[0-2]/", "c": "fetch2(id:)", "d": "s:7"}
    return symbols.find_batch(_symbols(spark, d), queries).groupBy("query").agg(F.count("*").alias("n"))


def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return symbols.regex_search(names, symbols.trigram_index(names), "l.*idge[a-z]|^s[a-z]+ ring$").select("id")


def trigram_prefilter(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return symbols.regex_search(names, symbols.trigram_index(names), "^BUILD.*G$").select("id")


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    roles = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 8 + 4).when(F.col("event_type") == "purchase", 16).otherwise(4)
    e = F.col("event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("usr"), F.concat(F.lit("f"), (e % 9).cast("string")).alias("file"), (e % 100).cast("int").alias("line"), e.alias("col"), roles.alias("roles"))


def by_usr(spark: SparkSession, d: str) -> DataFrame:
    return symbols.by_usr(_occurrences(spark, d), 2).select("usr", "file", "line", "col")


def usages(spark: SparkSession, d: str) -> DataFrame:
    kind = symbols.usage_kind(F.col("roles"), 16, 8, 4)
    return _occurrences(spark, d).groupBy("usr", kind.alias("kind")).agg(F.count("*").alias("n"))


def context(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("n", "content")).select("file", (F.col("n") + 1).alias("line"), "content")
    matches = lines.where("content like 'Licensed%'").select("file", "line")
    return symbols.context(lines, matches, 1, 2).select("file", "match", "line", F.md5(F.col("content").cast("binary")).alias("content"), "highlighted")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    hashed = lambda df: df.select("path", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    now = docs.where("path % 11 <> 0").withColumn("text", F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return hashed(now), hashed(docs.where("path % 13 <> 0"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_snapshots(spark, d))


def hit_statistics(spark: SparkSession, d: str) -> DataFrame:
    return incremental.hit_statistics(changes(spark, d))


def refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Token counts by file, kept for unchanged files and made anew for the others."""
    now, before = _snapshots(spark, d)
    changed = incremental.changes(now, before).where("change <> 'unchanged'")
    rows = lambda df: df.select(F.col("path").alias("file"), F.substring("content_hash", 1, 8).alias("row"))
    fresh = rows(now.join(changed.select("path"), "path", "left_semi"))
    return incremental.refreshed(rows(before), fresh, changed)


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    refs = _t(spark, d, "orders").select(F.concat(F.lit("f"), (o % 60).cast("string")).alias("file"), F.col("o_custkey").cast("string").alias("identifier"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("context"))
    decls = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("file"))
    return incremental.file_dependencies(refs, decls)


def dependency_statistics(spark: SparkSession, d: str) -> DataFrame:
    return incremental.dependency_statistics(_dependencies(spark, d))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _t(spark, d, "events").select(
        F.concat(F.lit("f"), (e % 37).cast("string")).alias("file"), (e % 50).cast("int").alias("line"), (e % 3).cast("int").alias("col"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("note").alias("severity"), F.col("event_type").alias("message"),
    )


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return incremental.deduplicated(_diagnostics(spark, d), "line")


def capped(spark: SparkSession, d: str) -> DataFrame:
    return incremental.capped(_diagnostics(spark, d), 5)


def compiler_lines(spark: SparkSession, d: str) -> DataFrame:
    return incremental.compiler_lines(_diagnostics(spark, d).where("severity = 'error'")).select("text")


def compact(spark: SparkSession, d: str) -> DataFrame:
    return incremental.compact_by_file(_diagnostics(spark, d).where("severity = 'error'"))


def json_report(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostics(spark, d).where("severity = 'warning'").select(F.to_json(F.struct("col", "file", "line", "message", "severity")).alias("json"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.with_notes(_diagnostics(spark, d).distinct())


QUERIES = {
    "s2_name": by_name, "s3_qualified": qualified, "s4_selector": selector, "s6_regex": regex, "s11_batch": batch, "s7_trigram": trigram_prefilter, "s6_regex_search": trigram_search, "s8_usr": by_usr, "s10_usages": usages,
    "s12_context": context, "i1_changes": changes, "i5_refreshed": refreshed, "i6_hit_statistics": hit_statistics, "i3_file_deps": _dependencies, "i4_stats": dependency_statistics, "n1_dedupe": deduplicated,
    "n2_cap": capped, "n4_group_notes": notes, "z3_compiler_lines": compiler_lines, "z2_compact": compact, "z1_json": json_report,
}

_S = """sym AS (SELECT s_suppkey AS id, 'fetch' || (s_suppkey % 7) AS name, CASE s_suppkey % 3 WHEN 0 THEN ['id', NULL] WHEN 1 THEN ['id'] END AS labels, 'f' || (s_suppkey % 5) AS file, CAST(s_suppkey // 5 AS INT) AS line, s_nationkey FROM supplier)"""
_O = """occ AS (SELECT user_id AS usr, 'f' || (event_id % 9) AS file, CAST(event_id % 100 AS INT) AS line, event_id AS col, CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 12 WHEN 'purchase' THEN 16 ELSE 4 END AS roles FROM events)"""
_SNAP = """now AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS new FROM documents WHERE doc_id % 11 <> 0), old AS (SELECT doc_id AS path, md5(text) AS old FROM documents WHERE doc_id % 13 <> 0),
ch AS (SELECT path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old = new THEN 'unchanged' ELSE 'modified' END AS change FROM now FULL JOIN old USING (path))"""
_DEPS = """deps AS (SELECT DISTINCT 'f' || (o_orderkey % 60) AS dependent, 'f' || (c_custkey % 40) AS dependency, lower(o_orderpriority[1:1]) AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 60 <> c_custkey % 40)"""
_DIAG = """diag AS (SELECT 'f' || (event_id % 37) AS file, CAST(event_id % 50 AS INT) AS line, CAST(event_id % 3 AS INT) AS col, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'note' END AS severity, event_type AS message FROM events)"""

ORACLES = {
    "s2_name": f"WITH {_S} SELECT id, file, line FROM sym WHERE name = 'fetch3'",
    "s3_qualified": f"WITH {_S} SELECT id FROM sym WHERE name = 'fetch1' AND s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)",
    "s4_selector": f"WITH {_S} SELECT id FROM sym WHERE name = 'fetch2' AND id % 3 = 0",
    "s6_regex": f"WITH {_S} SELECT id FROM sym WHERE regexp_full_match(name, 'fetch[1-4]') ORDER BY file, line LIMIT 50",
    "s11_batch": f"WITH {_S}, x AS (SELECT 'a' AS query, count(*) AS n FROM sym WHERE name = 'fetch1' UNION ALL SELECT 'b', count(*) FROM sym WHERE regexp_matches(name, '^fetch[0-2]$') UNION ALL SELECT 'c', count(*) FROM sym WHERE name = 'fetch2' AND id % 3 = 1 UNION ALL SELECT 'd', count(*) FROM sym WHERE id = 7) SELECT * FROM x WHERE n > 0",
    "s7_trigram": "SELECT c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, '^BUILD.*G$')",
    "s6_regex_search": "SELECT p_partkey AS id FROM part WHERE regexp_matches(p_name, 'l.*idge[a-z]|^s[a-z]+ ring$')",
    "s8_usr": f"WITH {_O} SELECT usr, file, line, col FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY roles & 2 <> 0 DESC, file, line, col) AS n FROM occ) WHERE n = 1",
    "s10_usages": f"WITH {_O} SELECT usr, CASE WHEN roles & 16 <> 0 THEN 'call' WHEN roles & 8 <> 0 THEN 'write' WHEN roles & 4 <> 0 THEN 'read' ELSE 'reference' END AS kind, count(*) AS n FROM occ GROUP BY ALL",
    "s12_context": """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line FROM documents), m AS (SELECT file, line AS match FROM l WHERE starts_with(content, 'Licensed'))
SELECT file, match, line, md5(content) AS content, line = match AS highlighted FROM m JOIN l USING (file) WHERE line BETWEEN match - 1 AND match + 2""",
    "i1_changes": f"WITH {_SNAP} SELECT path, change FROM ch",
    "i6_hit_statistics": f"WITH {_SNAP}, c AS (SELECT count(*) FILTER (change <> 'deleted') AS files, count(*) FILTER (change = 'unchanged') AS hits FROM ch) SELECT files, hits, round(hits * 100.0 / files, 6)::DOUBLE AS hit_rate, hits * 10 AS saved_ms FROM c",
    "i5_refreshed": f"WITH {_SNAP} SELECT path AS file, new[1:8] AS row FROM now",
    "i3_file_deps": f"WITH {_DEPS} SELECT * FROM deps",
    "i4_stats": f"WITH {_DEPS} SELECT count(*) AS dependencies, count(DISTINCT dependent) AS dependents, count(DISTINCT dependency) AS files_used, round(count(*) / count(DISTINCT dependent), 9) AS mean FROM deps",
    "n1_dedupe": f"WITH {_DIAG} SELECT file, line, col, severity, message FROM (SELECT *, row_number() OVER (PARTITION BY file, line, severity ORDER BY col, message) AS n FROM diag) WHERE n = 1",
    "n2_cap": f"""WITH {_DIAG}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, col, severity, message) AS n, count(*) OVER (PARTITION BY file) AS c FROM diag)
SELECT file, line, col, CASE WHEN n = 6 THEN 'note' ELSE severity END AS severity, CASE WHEN n = 6 THEN (c - 5) || ' more diagnostics are not shown' ELSE message END AS message FROM r WHERE n <= 6""",
    "z3_compiler_lines": f"WITH {_DIAG} SELECT file || ':' || line || ':' || col || ': ' || severity || ': ' || message AS text FROM diag WHERE severity = 'error'",
    "z2_compact": f"WITH {_DIAG} SELECT file, string_agg(line || ': ' || message, chr(10) ORDER BY line, message) AS report FROM diag WHERE severity = 'error' GROUP BY file",
    "z1_json": f"""WITH {_DIAG} SELECT '{{"col":' || col || ',"file":"' || file || '","line":' || line || ',"message":"' || message || '","severity":"' || severity || '"}}' AS json FROM diag WHERE severity = 'warning'""",
}
