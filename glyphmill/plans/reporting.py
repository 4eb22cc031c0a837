"""Queries on report forms, member edges, index edges and signature search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, minhash, reports
from ..operators.checkpoints import cut
from . import similar


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").where("event_type = 'error'").select(F.lit("function").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.lit("Consider")).alias("suggestion"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("file"), F.col("event_id").alias("line"), (F.col("user_id") % 80).alias("col"))
    return reports.unused_results(rows)


def signatures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.struct(F.when(k % 3 == 0, F.lit("id")).when(k % 3 == 1, F.lit("value")).alias("label"), F.lit("value").alias("name"), F.lit("Int").alias("type"), (k % 2 == 0).alias("is_inout"), (k % 5 == 0).alias("is_variadic"))
    return _t(spark, d, "supplier").select("s_suppkey", reports.parameter_text(first).alias("parameter"), reports.selector_text(F.lit("fetch"), F.array(first, first)).alias("selector"))


def wrappers(spark: SparkSession, d: str) -> DataFrame:
    attribute = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@State("), "p_name", F.lit(")"))).otherwise(F.concat(F.lit("@"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")))
    found = _t(spark, d, "part").select("p_partkey", reports.wrapper(attribute).alias("w"), reports.conformance_kind(F.when(F.col("p_size") < 5, "UI.View").otherwise(F.col("p_type"))).alias("conforms"))
    return found.select("p_partkey", "w.kind", "w.arguments", "conforms")


def member_edges(spark: SparkSession, d: str) -> DataFrame:
    nation, customer = _t(spark, d, "nation"), _t(spark, d, "customer")
    types = nation.select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "protocol").otherwise("class").alias("kind"), F.lit("file:0").alias("scope_id"), F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("own_scope"))
    methods = customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("m"), (F.col("c_custkey") % 70).cast("string")).alias("name"), F.lit("method").alias("kind"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("scope_id"), F.lit(None).cast("string").alias("own_scope"))
    return graph.member_edges(types.unionByName(methods))


def index_edges(spark: SparkSession, d: str) -> DataFrame:
    roles = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type").isin("view", "click"), 4).otherwise(1)
    rows = _t(spark, d, "events").select((F.col("user_id") % 97).alias("usr"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 89).alias("container"), roles.alias("roles"))
    return graph.index_edges(rows, 2, 4)


#: Values of a signature, and the bands and rows that the operator chooses for them at similarity 0.5.
WIDTH = 256
BANDS, ROWS = minhash.bands_and_rows(WIDTH, 0.5)


def _signed(spark: SparkSession, d: str, classes: bool = False) -> DataFrame:
    """Signatures of documents of five words or more: (id, sig). classes: of one document a class of equal sets."""
    docs = similar.hashes(spark, d)
    if classes:
        docs = docs.join(minhash.set_classes(docs).where("id = rep").select("id"), "id", "left_semi")
    return cut(docs.select("id", minhash.signature(F.col("hashes"), WIDTH).alias("sig")))


def similar_to(spark: SparkSession, d: str) -> DataFrame:
    rows = _signed(spark, d)
    return minhash.similar_to(rows, rows.where("id % 20 = 0"), BANDS, ROWS, 0.5)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes of equal shingle sets; m15_groups has the members of the classes."""
    return minhash.candidates(_signed(spark, d, classes=True), BANDS, ROWS)


def estimates(spark: SparkSession, d: str) -> DataFrame:
    """Of each document and the next one."""
    rows = _signed(spark, d)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("sig").alias("other"))
    return rows.join(other, "id").select("id", minhash.signature_similarity(F.col("sig"), F.col("other")).alias("similarity"))


QUERIES = {"z4_sarif": sarif_results, "x17_signatures": signatures, "x19_wrappers": wrappers, "g5_member_edges": member_edges, "g12_index_edges": index_edges, "m10_similar_to": similar_to, "m9_candidates": candidates, "m4_estimate": estimates}

ORACLES = {
    "z4_sarif": """SELECT '{"ruleId":"unused-function","level":"warning","message":{"text":"' || CASE WHEN event_id % 2 = 0 THEN 'Consider' ELSE 'Unused declaration' END || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f' || (event_id % 9)
|| '"},"region":{"startLine":' || event_id || ',"startColumn":' || (user_id % 80) || '}}}]}' AS result FROM events WHERE event_type = 'error'""",
    "x17_signatures": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'id value' WHEN 1 THEN 'value' ELSE '_ value' END || ': ' || CASE WHEN s_suppkey % 2 = 0 THEN 'inout ' ELSE '' END || 'Int' || CASE WHEN s_suppkey % 5 = 0 THEN '...' ELSE '' END AS parameter,
'fetch(' || repeat(CASE s_suppkey % 3 WHEN 0 THEN 'id:' WHEN 1 THEN 'value:' ELSE '_:' END, 2) || ')' AS selector FROM supplier""",
    "x19_wrappers": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'State' ELSE regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') END AS kind, CASE WHEN p_size % 2 = 0 THEN p_name END AS arguments, CASE WHEN p_size < 5 THEN 'View' END AS conforms FROM part""",
    "g5_member_edges": """WITH t AS (SELECT CAST(-n_nationkey - 1 AS BIGINT) AS id, n_nationkey AS s, n_nationkey % 3 = 0 AS p FROM nation), m AS (SELECT c_custkey AS id, c_custkey % 70 AS name, c_nationkey AS s FROM customer)
SELECT t.id AS src, m.id AS dst, 'call' AS kind FROM t JOIN m USING (s) WHERE NOT p UNION SELECT a.id, b.id, 'typeReference' FROM t JOIN m a USING (s) JOIN m b ON a.name = b.name AND a.s <> b.s WHERE p""",
    "g12_index_edges": """WITH o AS (SELECT user_id % 97 AS usr, CASE WHEN event_id % 4 <> 0 THEN event_id % 89 END AS c, event_type AS e FROM events) SELECT DISTINCT c AS src, usr AS dst FROM o WHERE e IN ('view', 'click') AND c IS NOT NULL AND c <> usr AND usr IN (SELECT usr FROM o WHERE e = 'signup')""",
}
