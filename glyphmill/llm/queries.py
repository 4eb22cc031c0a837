"""Queries of this subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from .chat_format import op7_chat_format
from .fingerprints import op10_fingerprints
from .mixing import op4_mixing
from .near_dedup import op3_near_dedup
from .pii import op8_pii
from .sentencepiece_codec import op5_sentencepiece
from .sharding import op1_sharding
from .token_counts import op9_token_counts
from .topk import op6_topk
from .toxicity import op2_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_topk": op6_topk,
    "op7_chat_format": op7_chat_format,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
}

_OP3 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
-- of two sets alike, each has one of the other's shingles among its first 15 in 100 (and one more)
p AS (SELECT doc_id, unnest(list_sort(list_transform(s, lambda x: md5(x)))[1:len(s) - CAST(ceil(len(s) * 0.85) AS BIGINT) + 1]) AS g FROM s WHERE len(s) > 0),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g) WHERE a.doc_id < b.doc_id),
l AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t
      FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b) WHERE 100 * i >= 85 * (t - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
, r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS m FROM t GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM n LEFT JOIN r ON r.a = n.doc_id
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * (10 // weight), source NULLS LAST) AS i FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () * 3 - coalesce(sum(source_size * 4) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
             CAST(sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights_left FROM o),
c AS (SELECT *, weight * rest >= source_size * 4 * weights_left AS capped FROM l),
f AS (SELECT * FROM c WHERE NOT capped ORDER BY i LIMIT 1),
t AS (SELECT c.source, c.source_size, CASE WHEN c.capped THEN CAST(2 * c.source_size AS DOUBLE)
             ELSE CAST(c.weight * f.rest AS DOUBLE) / CAST(f.weights_left * 2 AS DOUBLE) END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * ((start + size / 2.0 <= target)::INT + (start + source_size + size / 2.0 <= target)::INT) AS BIGINT) AS taken FROM p
"""

_OP6 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_topk": _OP6,
    "op4_mixing": _OP4,
    "op3_near_dedup": _OP3,
}
