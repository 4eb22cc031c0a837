"""Queries on MinHash similarity and on embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_grams, jaccard, tokens
from ..operators import embeddings, minhash
from ..operators.checkpoints import cut, spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sets of 5-word shingle hashes (60 bits of md5)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r\f]+", -1), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice("w", i, 5), " ").cast("binary")), 1, 15), 16, 10).cast("long"))
    docs = spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", words.alias("w")).where("size(w) >= 5")
    return docs.select(F.col("doc_id").alias("id"), F.array_distinct(grams).alias("hashes"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.explode(minhash.blocks(tokens(F.col("text")), 40)).alias("b"))
    return docs.select("doc_id", F.col("b.start").cast("long").alias("start"), F.md5(F.array_join("b.tokens", " ").cast("binary")).alias("block"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return hashes(spark, d).select("id", F.size("hashes").cast("long").alias("shingles"), F.array_min("hashes").alias("least"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    docs = hashes(spark, d)
    return docs.select("id", F.posexplode(minhash.signature(F.col("hashes"))).alias("i", "value")).select("id", F.col("i").cast("long").alias("i"), "value")


def verified(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a band of their signatures, with an exact similarity of 0.8 or more."""
    return _pairs(spark, d).select("id1", "id2", F.round("similarity", 9).alias("similarity"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between different sets, and of each copy with the first document of its set."""
    docs = cut(hashes(spark, d))
    n = 128
    classes = cut(minhash.set_classes(docs))
    reps = docs.join(classes.where("id = rep").select("id"), "id", "left_semi")
    signed = cut(reps.select("id", minhash.signature(F.col("hashes"), n).alias("sig")))
    links = minhash.verified(minhash.candidates(signed, n // 4, 4), reps, 0.8)
    copies = classes.where("id <> rep").select(F.col("rep").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("similarity"))
    return links.unionByName(copies)


def similar_groups(spark: SparkSession, d: str) -> DataFrame:
    return minhash.groups(cut(_pairs(spark, d))).select("component", "members", F.round("similarity", 6).alias("similarity"), "fingerprint")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    pairs = cut(_pairs(spark, d))
    both = pairs.select(F.col("id1").alias("id")).unionByName(pairs.select(F.col("id2").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the expanded weighted hashes of each benchmark item's words."""
    words = _t(spark, d, "benchmark").select("item_id", F.explode(F.filter(F.split("text", "[ \n]+", -1), lambda w: w != "")).alias("w"))
    counted = words.groupBy("item_id", "w").agg(F.count("*").alias("count")).select("item_id", F.struct(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 10), 16, 10).cast("long").alias("hash"), "count").alias("e"))
    grouped = counted.groupBy("item_id").agg(F.collect_list("e").alias("e")).select("item_id", minhash.weighted_hashes(F.col("e")).alias("h"))
    return grouped.select("item_id", F.size("h").cast("long").alias("n"), F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.hashed_grams(_t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 128)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("module"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    found = embeddings.nearest(_vectors(spark, d), _vectors(spark, d).where("id % 20 = 0"), 6)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


def search(spark: SparkSession, d: str) -> DataFrame:
    found = embeddings.nearest(_vectors(spark, d), _vectors(spark, d).where("id = 7"), 10, own=True)
    return found.select("id", F.round("similarity", 6).alias("similarity"), "rank")


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Of all vectors, 1 - the mean of the five nearest similarities; the twenty oddest."""
    near = embeddings.nearest(_vectors(spark, d), _vectors(spark, d), 5)
    return embeddings.anomaly_scores(near, 20).select("query", F.round("score", 6).alias("score"))


def cohesion(spark: SparkSession, d: str) -> DataFrame:
    out = embeddings.cohesion(_vectors(spark, d))
    return out.select("module", "members", F.round("inside", 6).alias("inside"), F.round("across", 6).alias("across"), F.round("cohesion", 6).alias("cohesion"))


def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    """Labels as groups: kept if the least pairwise cosine of their members is -0.2 or more."""
    return embeddings.least_cosines(_vectors(spark, d), "module").select("module", F.round("least", 6).alias("least"), (F.round("least", 6) >= -0.2).alias("kept"))


def shape_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive parts: Jaccard of the character trigrams of their names."""
    part = _t(spark, d, "part").select("p_partkey", char_grams(F.col("p_name"), 3).alias("g"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("g").alias("h"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(jaccard(F.col("g"), F.col("h")), 9).alias("score"))


QUERIES = {
    "m1_blocks": blocks, "m2_shingles": shingle_counts, "m3_signatures": signatures, "m12_verified": verified, "m15_groups": similar_groups, "m18_degree": degrees, "m5_weighted": weighted,
    "e1_hash_embed": hash_embedding, "e2_knn": knn, "e10_search": search, "e11_anomaly": anomalies, "e12_cohesion": cohesion, "e4_verify": semantic_groups, "e6_shape_rerank": shape_rerank,
}

_H = """w AS (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: CAST('0x' || md5(array_to_string(w[i:i + 4], ' '))[1:15] AS BIGINT))) AS s FROM w WHERE len(w) >= 5)"""
# pairs alike share one of the first fifth of either's sorted hashes
_PAIRS = f"""{_H}, k AS (SELECT id, min(id) OVER (PARTITION BY list_sort(s)) AS rep, s FROM h), p AS (SELECT id, unnest(list_sort(s)[1:len(s) - CAST(ceil(len(s) * 0.8) AS BIGINT) + 1]) AS g FROM k WHERE id = rep), c AS (SELECT DISTINCT a.id AS id1, b.id AS id2 FROM p a JOIN p b USING (g) WHERE a.id < b.id),
l AS (SELECT id1, id2, i / (t - i) AS similarity FROM (SELECT id1, id2, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM c JOIN h x ON x.id = id1 JOIN h y ON y.id = id2) WHERE i / (t - i) >= 0.8 UNION ALL SELECT rep, id, 1.0 FROM k WHERE id <> rep)"""
_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label AS module FROM embeddings)"

ORACLES = {
    "m1_blocks": """WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}_][\\p{L}0-9_]*|[0-9]+|[^ \\t\\n\\r\\f\\p{L}0-9_]') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, len(t) - 39, 20)) AS start FROM t WHERE len(t) >= 40) SELECT doc_id, start, md5(array_to_string(t[start + 1:start + 40], ' ')) AS block FROM s""",
    "m2_shingles": f"WITH {_H} SELECT id, len(s) AS shingles, list_min(s) AS least FROM h",
    "e1_hash_embed": None,
    "m5_weighted": """WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) AS w FROM benchmark), c AS (SELECT item_id, CAST('0x' || md5(w)[1:10] AS BIGINT) AS h, least(count(*), 10) AS n FROM w GROUP BY item_id, w)
SELECT item_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(h * n + 2654435761 * (n * (n - 1) // 2)) AS BIGINT) AS total FROM c GROUP BY item_id""",
    "e2_knn": f"""WITH {_V}, s AS (SELECT q.id AS query, c.id, list_cosine_similarity(q.v, c.v) AS x FROM v q JOIN v c ON q.id % 20 = 0 AND c.id <> q.id),
r AS (SELECT query, id, round(x, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY x DESC, id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 6""",
    "e10_search": f"""WITH {_V}, r AS (SELECT c.id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity, CAST(row_number() OVER (ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.id) AS INTEGER) AS rank FROM v q JOIN v c ON q.id = 7) SELECT * FROM r WHERE rank <= 10""",
    "e11_anomaly": f"""WITH {_V}, s AS (SELECT q.id AS query, c.id, list_cosine_similarity(q.v, c.v) AS x FROM v q JOIN v c ON c.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, id) AS n FROM s)
SELECT query, round(1 - avg(x), 6) AS score FROM r WHERE n <= 5 GROUP BY query ORDER BY 1 - avg(x) DESC, query LIMIT 20""",
    "e12_cohesion": f"""WITH {_V}, s AS (SELECT a.module, a.module = b.module AS same, list_cosine_similarity(a.v, b.v) AS x FROM v a JOIN v b ON a.id <> b.id)
SELECT module, (SELECT count(*) FROM v WHERE v.module = s.module) AS members, round(avg(x) FILTER (same), 6) AS inside, round(avg(x) FILTER (NOT same), 6) AS across, round(avg(x) FILTER (same) - avg(x) FILTER (NOT same), 6) AS cohesion FROM s GROUP BY module""",
    "e4_verify": f"""WITH {_V}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY id) AS n FROM v))
SELECT a.module, round(min(list_cosine_similarity(a.v, b.v)), 6) AS least, round(min(list_cosine_similarity(a.v, b.v)), 6) >= -0.2 AS kept FROM f a JOIN f b ON a.module = b.module AND a.id < b.id GROUP BY a.module""",
    "e6_shape_rerank": """WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3))) AS g FROM part)
SELECT a.p_partkey, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS score FROM g a JOIN g b ON b.p_partkey = a.p_partkey + 1""",
    "m12_verified": f"WITH {_PAIRS} SELECT id1, id2, round(similarity, 9) AS similarity FROM l",
    "m18_degree": f"WITH {_PAIRS} SELECT id, count(*) AS degree FROM (SELECT id1 AS id FROM l UNION ALL SELECT id2 FROM l) GROUP BY id",
    "m15_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT id1 AS u, id2 AS v FROM l UNION SELECT id2, id1 FROM l), r AS (SELECT u AS a, u AS b FROM e UNION SELECT a, v FROM r JOIN e ON b = u), z AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS members, (SELECT round(avg(similarity), 6) FROM l JOIN z x ON x.node = id1 WHERE x.component = z.component) AS similarity, string_agg(CAST(node AS VARCHAR), '-' ORDER BY node) AS fingerprint FROM z GROUP BY component""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
