"""Queries on tokens, lines, normal forms and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..functions.text import TOKEN_PATTERN
from ..operators import minhash


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    token = F.explode(text.tokens(F.col("text"))).alias("token")
    return _t(spark, d, "documents").select(token).groupBy(text.token_kind(F.col("token"), ("the", "of", "der", "la", "le")).alias("kind")).agg(F.count("*").alias("n"))


def tokens_in_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return lines.where(F.col("line").between(1, 4)).groupBy("doc_id").agg(F.sum(F.size(text.tokens(F.col("content")))).cast("long").alias("n_tokens"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.snippet(F.col("text"), F.lit(2), F.lit(5)).cast("binary")).alias("snippet_md5"))


def corpus_info(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    lines = F.size(F.split("text", "\n", -1))
    return docs.groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(lines).cast("long").alias("lines")
    )


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("root/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = _t(spark, d, "documents").select("doc_id", path.alias("path"))
    hit = patterns.matches_glob(F.col("path"), "root/src1?/**", "**/en/doc*7.txt")
    return docs.where(~hit).select("doc_id", "path", text.module_key(F.col("path"), 2).alias("module"))


def line_marker_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.where(~F.exists(F.split("text", "\n", -1), lambda x: F.ltrim(x).startswith("Licensed"))).select("doc_id")


def normalised_tokens(spark: SparkSession, d: str) -> DataFrame:
    token = _t(spark, d, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("token"))
    kind = text.token_kind(F.col("token"))
    return token.groupBy("lang", text.normalised(F.col("token"), kind, ("the", "of", "a")).alias("norm")).agg(F.count("*").alias("n"))


def positional_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block of each text, as m1_blocks cuts them, in positional form."""
    docs = _t(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    block = docs.select("doc_id", F.explode(minhash.blocks(F.col("t"), 40)).alias("b"))
    items = F.transform("b.tokens", lambda t: F.struct(text.token_kind(t).alias("kind"), t.alias("text")))
    return block.select("doc_id", F.col("b.start").cast("long").alias("start"), items.alias("items")).select("doc_id", "start", F.array_join(text.positional(F.col("items")), " ").alias("form"))


def char_gram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", F.size(text.char_grams(F.col("text"), 9)).cast("long").alias("grams"), F.size(text.trigrams(F.col("text"))).cast("long").alias("trigrams"))


def literal_forms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", text.plain_literals(F.col("props")).alias("form"))


def identifier_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of consecutive documents and the Jaccard of their identifier sets."""
    docs = _t(spark, d, "documents").select("doc_id", text.identifier_set(F.col("text")).alias("ids"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ids").alias("other"))
    score = text.jaccard(F.col("ids"), F.col("other"))
    return docs.join(after, "doc_id").select("doc_id", F.round(score, 9).alias("jaccard"), F.round(text.fused_score(F.lit(0.5), score), 9).alias("fused"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name").cast("binary")).alias("fnv"))


def type_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.array_join(text.type_names(F.concat(F.initcap("c_mktsegment"), F.lit("<"), "c_name", F.lit(", Int>"))), ",").alias("types"))


_TOKENS = f"regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}')"
_PUNCT = text.PUNCTUATION.replace("'", "''")


def _kind_sql(t: str, keywords: tuple[str, ...] = ()) -> str:
    words = f"WHEN {t} IN ({', '.join(repr(w) for w in keywords)}) THEN 'keyword' " if keywords else ""
    return f"CASE {words}WHEN regexp_matches({t}, '^[\\p{{L}}_]') THEN 'identifier' WHEN regexp_matches({t}, '^[0-9]') THEN 'literal' WHEN strpos('{_PUNCT}', {t}) > 0 THEN 'punctuation' ELSE 'operator' END"


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

QUERIES = {
    "a4_token_kinds": token_kinds,
    "f13_tokens_in_lines": tokens_in_lines,
    "f14_snippets": snippets,
    "r1_corpus_info": corpus_info,
    "f1_glob_filter": glob_filter,
    "f9_line_marker_filter": line_marker_filter,
    "x7_normalised_tokens": normalised_tokens,
    "x8_positional_blocks": positional_blocks,
    "x9_char_grams": char_gram_counts,
    "x10_literal_forms": literal_forms,
    "x12_identifier_overlap": identifier_overlap,
    "x1_fnv1a": content_hashes,
    "x15_type_names": type_annotations,
}

ORACLES = {
    "a4_token_kinds": f"SELECT {_kind_sql('t', ('the', 'of', 'der', 'la', 'le'))} AS kind, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM documents) GROUP BY 1",
    "f13_tokens_in_lines": f"""SELECT doc_id, CAST(sum(len(regexp_extract_all(l, '{TOKEN_PATTERN}'))) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i BETWEEN 2 AND 5 GROUP BY doc_id""",
    "f14_snippets": "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:5], chr(10))) AS snippet_md5 FROM documents",
    "r1_corpus_info": "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY source",
    "f1_glob_filter": r"""WITH p AS (SELECT doc_id, 'root/' || source || '/' || lang || '/doc' || doc_id || '.txt' AS path, source || '/' || lang AS module FROM documents)
SELECT * FROM p WHERE NOT regexp_full_match(path, 'root/src1[^/]/.*') AND NOT regexp_full_match(path, '(?:.*/)?en/doc[^/]*7\.txt')""",
    "f9_line_marker_filter": "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'Licensed'))) = 0",
    "x7_normalised_tokens": f"""SELECT lang, CASE WHEN k = 'identifier' AND t NOT IN ('the', 'of', 'a') THEN '$ID' WHEN k = 'literal' THEN '$NUM' ELSE t END AS norm, count(*) AS n
FROM (SELECT lang, t, {_kind_sql('t')} AS k FROM (SELECT lang, unnest({_TOKENS}) AS t FROM documents)) GROUP BY ALL""",
    "x9_char_grams": """SELECT item_id, CAST(CASE WHEN length(text) >= 9 THEN len(list_distinct(list_transform(range(1, length(text) - 7), lambda i: substring(text, i, 9)))) ELSE 0 END AS BIGINT) AS grams,
CAST(CASE WHEN length(text) >= 3 THEN len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) ELSE 0 END AS BIGINT) AS trigrams FROM benchmark""",
    "x10_literal_forms": r"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(props, '"[^"]*"', '"$STR"', 'g'), '\b[0-9]+(\.[0-9]+)?\b', '$NUM', 'g'), '\$[0-9]+', '$X', 'g') AS form FROM events""",
    "x12_identifier_overlap": f"""WITH s AS (SELECT doc_id, list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))), lambda x: x NOT IN ({_STOP})) AS s FROM documents),
j AS (SELECT a.doc_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN t > 0 THEN i / (t - i) ELSE 0 END, 9) AS jaccard, round(0.6 * 0.5 + 0.4 * CASE WHEN t > 0 THEN i / (t - i) ELSE 0 END, 9) AS fused FROM j""",
    "x15_type_names": """SELECT c_custkey, array_to_string(list_filter([upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), string_split(c_name, '#')[1]], lambda x: regexp_matches(x, '^[A-Z]')), ',') AS types FROM customer""",
}
# first occurrences need an ordered distinct: by position within the list
ORACLES["x8_positional_blocks"] = f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), b AS (SELECT doc_id, t, unnest(range(0, len(t) - 39, 20)) AS start FROM t WHERE len(t) >= 40),
e AS (SELECT doc_id, start, unnest(t[start + 1:start + 40]) AS t, unnest(range(40)) AS i FROM b),
k AS (SELECT *, {_kind_sql('t')} AS k FROM e),
f AS (SELECT doc_id, start, t, k, min(i) AS f FROM k WHERE k IN ('identifier', 'literal') GROUP BY ALL),
n AS (SELECT doc_id, start, t, (CASE WHEN k = 'identifier' THEN '$ID' ELSE '$LIT' END) || (row_number() OVER (PARTITION BY doc_id, start, k ORDER BY f) - 1) AS name FROM f)
SELECT k.doc_id, k.start, string_agg(coalesce(n.name, k.t), ' ' ORDER BY i) AS form FROM k LEFT JOIN n USING (doc_id, start, t) GROUP BY k.doc_id, k.start"""
