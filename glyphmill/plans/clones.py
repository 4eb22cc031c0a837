"""Queries on duplicate token windows and on functions' data flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, token_kind, tokens
from ..operators import clones, dataflow
from ..operators.checkpoints import spread

#: Tokens in a window of the flagship query.
WINDOW = 20


def exact_classes(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """Classes of equal token windows that occur at two or more places: fingerprint, occurrences, documents."""
    return clones.repeated_classes(_documents(spark, sf_dir), tokens(F.col("text")), window)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_t(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


def nonoverlapping(spark: SparkSession, d: str) -> DataFrame:
    """Repeated windows without those that overlap the last kept one of their file, by gram."""
    return clones.kept_counts(_documents(spark, d), tokens(F.col("text")), WINDOW)


def greedy(spark: SparkSession, d: str) -> DataFrame:
    """Seed-greedy groups, by gram: groups and members."""
    return clones.greedy_counts(_documents(spark, d), tokens(F.col("text")), WINDOW)


def normalised_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of windows that are equal once numbers are one placeholder."""
    plain = F.transform(tokens(F.col("text")), lambda t: F.when(token_kind(t) == "literal", "$NUM").otherwise(t))
    found = clones.windows(_documents(spark, d), plain, WINDOW)
    return found.groupBy("gram").agg(F.count("*").alias("occurrences")).where("occurrences >= 2")


def pattern_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the eight-token windows of benchmark items occur in documents."""
    items = clones.windows(_t(spark, d, "benchmark").withColumnRenamed("item_id", "pattern_id"), tokens(F.col("text")), 8, "pattern_id")
    patterns = items.select("pattern_id", "gram").distinct()
    found = clones.pattern_places(_documents(spark, d), tokens(F.col("text")), patterns, 8)
    return found.select("pattern_id", "file", F.col("start").cast("long").alias("start"))


def line_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as groups of locations, duplicates of one location set left out."""
    lines = _t(spark, d, "documents").select(F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("loc"), F.explode_outer(F.split("text", "\n", -1)).alias("line"))
    groups = lines.groupBy(F.md5(F.col("line").cast("binary")).alias("group")).agg(F.sort_array(F.collect_set("loc")).alias("locations"))
    return clones.deduplicated(groups).select("group", F.array_join("locations", "|").alias("locations"))


def report(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n", -1)).alias("lines"), F.md5(F.col("text").cast("binary")).alias("group"))
    twice = files.groupBy("group").agg(F.count("*").alias("n")).where("n >= 2").select("group")
    return clones.report(files.join(twice, "group", "left_semi"), files.select("file", "lines"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("n", "content"))
    return lines.select("file", (F.col("n") + 1).alias("line"), "content")


def ignore_regions(spark: SparkSession, d: str) -> DataFrame:
    return clones.ignore_regions(_numbered(spark, d), "the the", "and").select("file", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def without_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Documents' three-line blocks, by their first line's length, that touch no ignore region."""
    regions = clones.ignore_regions(_numbered(spark, d), "the the", "and")
    blocks = _numbered(spark, d).where("line % 3 = 1").select((F.char_length("content")).cast("long").alias("group"), "file", F.col("line").alias("start"), (F.col("line") + 2).alias("stop"))
    return clones.without_ignored(blocks, regions).groupBy("group").agg(F.count("*").alias("members"))


def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as syntax nodes: brand is the hash, type the root kind, size the node count."""
    nodes = _t(spark, d, "part").select(F.col("p_brand").alias("hash"), F.col("p_type").alias("root_kind"), F.col("p_partkey").alias("file"), F.lit(1).alias("start"), F.col("p_size").alias("node_count"))
    return clones.fingerprint_groups(nodes).select("hash", "root_kind", "members", F.round("similarity", 6).alias("similarity"))


def near_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "benchmark").select((F.col("item_id") % 9).alias("group"), F.col("item_id").alias("id"), F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    return clones.near_similarity(rows).select("group", F.round("similarity", 9).alias("similarity"))


def _functions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as functions: lines are blocks in order, with a back edge from the last to the first; each block reads a
    variable named after its part and writes one named after its supplier."""
    item = _t(spark, d, "lineitem")
    name = lambda c, n: F.concat(F.lit("v"), (F.col(c) % n).cast("string"))
    block = F.concat(F.lit("b"), F.col("l_linenumber").cast("string"))
    first = item.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    statements = first.select(F.col("l_orderkey").alias("fn"), block.alias("block"), F.lit(0).alias("idx"), F.array(name("l_partkey", 5)).alias("uses"), F.array(name("l_suppkey", 4)).alias("defs"))
    order = Window.partitionBy("fn").orderBy("l_linenumber")
    chained = first.select(F.col("l_orderkey").alias("fn"), "l_linenumber", block.alias("src")).withColumn("dst", F.coalesce(F.lead("src").over(order), F.first("src").over(order)))
    return statements, chained.select("fn", "src", "dst")


def live_variables(spark: SparkSession, d: str) -> DataFrame:
    out = dataflow.live_variables(*_functions(spark, d))
    return out.select("fn", "block", F.array_join("live_in", ",").alias("live_in"), F.array_join("live_out", ",").alias("live_out"))


def reaching(spark: SparkSession, d: str) -> DataFrame:
    out = dataflow.reaching_definitions(*_functions(spark, d))
    return out.select("fn", "block", F.array_join("reaching", ",").alias("reaching"))


def dead_stores(spark: SparkSession, d: str) -> DataFrame:
    statements, edges = _functions(spark, d)
    return dataflow.dead_stores(statements, dataflow.live_variables(statements, edges)).select("fn", "block", "name")


def use_def(spark: SparkSession, d: str) -> DataFrame:
    out = dataflow.use_def(_functions(spark, d)[0])
    return out.select("fn", "block", F.array_join("use", ",").alias("use"), F.array_join("def", ",").alias("def"))


QUERIES = {
    "c7_exact_classes": exact_classes, "c9_nonoverlap": nonoverlapping, "c1_greedy": greedy, "c2_normalised_classes": normalised_classes, "c5_pattern_search": pattern_places, "c13_dedupe": line_groups, "c14_report": report,
    "f7_ignore_regions": ignore_regions, "f8_without_ignored": without_ignored, "c12_fingerprints": fingerprint_groups, "c2_near_similarity": near_similarity, "d4_live": live_variables, "d6_reach_defs": reaching, "d4_dead_stores": dead_stores, "d2_use_def": use_def,
}

_WIN = f"""t AS (SELECT doc_id AS file, regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}') AS t FROM documents),
w AS (SELECT file, unnest(range(0, len(t) - {WINDOW} + 1)) AS start, unnest(list_transform(range(1, len(t) - {WINDOW} + 2), lambda i: md5(array_to_string(t[i:i + {WINDOW} - 1], ' ')))) AS gram FROM t WHERE len(t) >= {WINDOW}),
r AS (SELECT * FROM w WHERE gram IN (SELECT gram FROM w GROUP BY gram HAVING count(*) >= 2))"""
_LINES = "l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_REG = f"""{_LINES}, m AS (SELECT file, line, CASE WHEN contains(content, 'the the') THEN 1 WHEN contains(content, 'and') THEN 0 END AS mark FROM l), n AS (SELECT *, lag(mark) OVER (PARTITION BY file ORDER BY line) AS b FROM m WHERE mark IS NOT NULL),
e AS (SELECT * FROM n WHERE (mark = 1 AND coalesce(b, 0) = 0) OR (mark = 0 AND b = 1)), p AS (SELECT file, line AS start, mark, lead(line) OVER (PARTITION BY file ORDER BY line) AS stop FROM e),
g AS (SELECT p.file, start, coalesce(stop, (SELECT max(line) FROM l WHERE l.file = p.file)) AS stop FROM p WHERE mark = 1)"""
_FN = """s AS (SELECT l_orderkey AS fn, l_linenumber AS n, 'b' || l_linenumber AS block, 'v' || (min(l_partkey) % 5) AS u, 'v' || (min(l_suppkey) % 4) AS d FROM lineitem GROUP BY ALL),
e AS (SELECT fn, block AS src, coalesce(lead(block) OVER w, first_value(block) OVER w) AS dst FROM s WINDOW w AS (PARTITION BY fn ORDER BY n)),
live AS (SELECT fn, block, u AS v FROM s UNION SELECT e.fn, e.src, live.v FROM live JOIN e ON e.fn = live.fn AND e.dst = live.block JOIN s ON s.fn = e.fn AND s.block = e.src WHERE s.d <> live.v),
outs AS (SELECT DISTINCT e.fn, e.src AS block, live.v FROM e JOIN live ON live.fn = e.fn AND live.block = e.dst)"""

ORACLES = {
    "c7_exact_classes": f"WITH {_WIN} SELECT gram AS fingerprint, count(*) AS occurrences, count(DISTINCT file) AS documents FROM r GROUP BY gram",
    "c9_nonoverlap": f"""WITH RECURSIVE {_WIN}, k AS (SELECT gram, file, min(start) AS start FROM r GROUP BY gram, file
UNION ALL SELECT k.gram, k.file, (SELECT min(start) FROM r WHERE r.gram = k.gram AND r.file = k.file AND r.start >= k.start + 10) FROM k WHERE EXISTS (SELECT 1 FROM r WHERE r.gram = k.gram AND r.file = k.file AND r.start >= k.start + 10))
SELECT gram, count(*) AS kept FROM k GROUP BY gram""",
    "c2_normalised_classes": f"""WITH t AS (SELECT list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '$NUM' ELSE x END) AS t FROM documents),
w AS (SELECT unnest(list_transform(range(1, len(t) - {WINDOW} + 2), lambda i: md5(array_to_string(t[i:i + {WINDOW} - 1], ' ')))) AS gram FROM t WHERE len(t) >= {WINDOW}) SELECT gram, count(*) AS occurrences FROM w GROUP BY gram HAVING count(*) >= 2""",
    "c5_pattern_search": f"""WITH t AS (SELECT doc_id AS file, regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}') AS t FROM documents), b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}') AS t FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS g FROM b WHERE len(t) >= 8),
w AS (SELECT file, unnest(range(0, len(t) - 7)) AS start, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS g FROM t WHERE len(t) >= 8) SELECT item_id AS pattern_id, file, start FROM w JOIN p USING (g)""",
    "c13_dedupe": """WITH l AS (SELECT md5(unnest(string_split(text, chr(10)))) AS "group", source || ':' || lang AS loc FROM documents),
g AS (SELECT "group", string_agg(DISTINCT loc, '|' ORDER BY loc) AS locations FROM l GROUP BY 1) SELECT min("group") AS "group", locations FROM g GROUP BY locations""",
    "c14_report": """WITH f AS (SELECT len(string_split(text, chr(10))) AS n, text FROM documents), g AS (SELECT sum(n) - max(n) AS d FROM f GROUP BY text HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM f) AS files, CAST((SELECT sum(n) FROM f) AS BIGINT) AS total_lines, count(*) AS groups, CAST(sum(d) AS BIGINT) AS duplicated_lines, round(sum(d) * 100.0 / (SELECT sum(n) FROM f), 6)::DOUBLE AS percent FROM g""",
    "f7_ignore_regions": f"WITH {_REG} SELECT file, start, stop FROM g",
    "f8_without_ignored": f"""WITH {_REG}, b AS (SELECT length(content) AS "group", file, line AS start, line + 2 AS stop FROM l WHERE line % 3 = 1), k AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.file = b.file AND b.start <= g.stop AND b.stop >= g.start))
SELECT "group", count(*) AS members FROM k GROUP BY "group" HAVING count(*) >= 2""",
    "c12_fingerprints": """WITH f AS (SELECT p_brand AS hash, p_type AS root_kind, p_partkey AS k, p_size AS c, first_value(p_size) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS f FROM part), n AS (SELECT * FROM f WHERE least(c, f) / greatest(c, f) >= 0.8)
SELECT a.hash, a.root_kind, (SELECT count(*) FROM n WHERE n.hash = a.hash AND n.root_kind = a.root_kind) AS members, round(avg(least(a.c, b.c) / greatest(a.c, b.c)), 6) AS similarity FROM n a JOIN n b ON a.hash = b.hash AND a.root_kind = b.root_kind AND a.k < b.k GROUP BY ALL""",
    "c2_near_similarity": f"""WITH t AS (SELECT item_id % 9 AS "group", item_id AS id, list_distinct(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS t FROM benchmark)
SELECT a."group", round(avg(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))), 9) AS similarity FROM t a JOIN t b ON a."group" = b."group" AND a.id < b.id GROUP BY a."group\"""",
    "d2_use_def": f"WITH RECURSIVE {_FN} SELECT fn, block, u AS use, d AS def FROM s",
    "d4_live": f"""WITH RECURSIVE {_FN} SELECT s.fn, s.block, (SELECT string_agg(v, ',' ORDER BY v) FROM live WHERE live.fn = s.fn AND live.block = s.block) AS live_in,
coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM outs WHERE outs.fn = s.fn AND outs.block = s.block), '') AS live_out FROM s""",
    "d4_dead_stores": f"WITH RECURSIVE {_FN} SELECT fn, block, d AS name FROM s WHERE NOT EXISTS (SELECT 1 FROM outs WHERE outs.fn = s.fn AND outs.block = s.block AND outs.v = s.d)",
    "d6_reach_defs": f"""WITH RECURSIVE {_FN}, r AS (SELECT e.fn, e.dst AS block, s.d AS v, s.d || '@' || s.block || ':0' AS x FROM e JOIN s ON s.fn = e.fn AND s.block = e.src
UNION SELECT e.fn, e.dst, r.v, r.x FROM r JOIN s ON s.fn = r.fn AND s.block = r.block JOIN e ON e.fn = r.fn AND e.src = r.block WHERE s.d <> r.v)
SELECT fn, block, string_agg(x, ',' ORDER BY x) AS reaching FROM (SELECT DISTINCT fn, block, x FROM r) GROUP BY ALL""",
}
