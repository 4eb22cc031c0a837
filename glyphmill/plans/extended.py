"""Queries on long repeats, subtrees, the compiler index, discovery by vectors and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, jaccard, tokens
from ..operators import clones, dataflow, discovery, embeddings, indexed, minhash, repeats
from ..operators.checkpoints import cut, spread
from . import graphs, similar
from . import clones as clone_plans


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))
    return repeats.repeat_groups(docs, tokens(F.col("text")), clone_plans.WINDOW)


def class_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(spark, d).select("gram", "occurrences", "documents", "length")


def maximal_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(spark, d).where("maximal").select("gram", "occurrences", "length")


def incremental_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of equal windows where the tokens of documents with even ids are cached, and of a third of these stale."""
    docs = spread(_t(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    stale = F.col("file") % 3 == 0
    cached = docs.where("file % 2 = 0").select("file", F.when(stale, F.lit("")).otherwise(digest).alias("hash"), F.when(stale, F.array(F.lit("old"))).otherwise(tokens(F.col("text"))).alias("tokens"))
    return clones.repeated_classes(repeats.refreshed_tokens(docs, cached, tokens), F.col("tokens"), clone_plans.WINDOW)


def subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trees: lines in order are nodes, their return flag the kind."""
    first = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").alias("pre")).agg((F.min("l_suppkey") % 3).alias("depth"), F.min("l_returnflag").alias("kind"))
    return repeats.subtree_prints(first, ["A", "R"], 2).select("tree", "pre", "kind", F.col("nodes").cast("long").alias("nodes"), "print")


def stale(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files, changed at their last order and indexed at their first line's shipping date of even orders."""
    orders = _t(spark, d, "orders")
    sources = _t(spark, d, "customer").join(orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("modified")), "c_custkey", "left").select(F.col("c_custkey").alias("file"), "modified")
    units = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("modified"))
    return indexed.stale_files(sources, units)


def _usr_symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as occurrences of symbols, customers as the symbols."""
    roles = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 4).otherwise(1)
    occurrences = _t(spark, d, "events").select((F.col("event_id") % 1499).alias("usr"), F.expr("event_id div 1499 % 3").alias("file"), roles.alias("roles"))
    k = F.col("c_custkey")
    name = F.when(k % 31 == 0, "init").when(k % 29 == 0, F.concat(F.lit("$"), k.cast("string"))).when(k % 5 == 0, F.concat(F.lit("test"), k.cast("string"))).otherwise(F.concat(F.lit("s"), k.cast("string")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("class", "method", "property", "extension")]), (k % 4 + 1).cast("int"))
    symbols = _t(spark, d, "customer").select(k.alias("usr"), name.alias("name"), kind.alias("kind"), (k % 23 == 0).alias("system"), F.concat(F.when(k % 2 == 0, "Tests/f").otherwise("Sources/f"), (k % 9).cast("string")).alias("file"), k.alias("line"))
    return occurrences, symbols


def index_unused(spark: SparkSession, d: str) -> DataFrame:
    return indexed.index_unused(*_usr_symbols(spark, d), 2, 4, test_file=F.col("file").startswith("Tests/"))


def index_report(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every tenth key are external; two regions are roots."""
    external = (F.col("kind") == "part") & F.col("id").endswith("7")
    reason = F.when(F.col("id") == "r0", "publicAPI").when(F.col("id") == "r2", "mainFunction")
    nodes = graphs.nodes(spark, d).select("id", "kind", external.alias("external"), reason.alias("root_reason"))
    return indexed.index_report(nodes, graphs.edges(spark, d))


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n", -1)).alias("lines"))
    return indexed.corpus_statistics(files, graphs.declarations(spark, d), graphs.references(spark, d))


#: Least cosine of the discovery query.
ALIKE = 0.4


def discovered(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as snippets of ten lines from line vec_id on in a file named by their label."""
    vectors = cut(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("file")))
    places = vectors.select("id", "file", F.col("id").alias("start_line"), (F.col("id") + 9).alias("end_line"))
    pairs = discovery.discovered_pairs(embeddings.nearest(vectors, vectors, 5), places, ALIKE)
    return discovery.discovered_groups(pairs)[0].select("component", "members", F.round("similarity", 6).alias("similarity"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Labels as groups: which presets their first two members pass, by cosine (raised by 0.8, as labels say little of the vectors) and by their rounded components' sets."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("module"))
    two = discovery.first_two(vectors.select("module", "id"), "module")
    side = lambda n: vectors.select(F.col("id").alias(f"id{n}"), F.col("v").alias(f"v{n}"))
    sets = [F.array_distinct(F.transform(f"v{n}", lambda x: F.floor(x * 20))) for n in (1, 2)]
    scored = two.join(side(1), "id1").join(side(2), "id2").select("module", "id1", "id2", (embeddings.cosine(F.col("v1"), F.col("v2")) + 0.8).alias("cosine"), jaccard(*sets).alias("jaccard"), F.lit(None).cast("double").alias("maxsim"), F.lit(None).cast("double").alias("tree"))
    return scored.select("module", "id1", "id2", *[discovery.accepted(p).alias(p) for p in discovery.PRESETS])


def dependence_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dependence graphs of part and supplier nodes, each scored against the one of the next key."""
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 3).alias("src"), F.col("l_returnflag").alias("src_kind"), (F.col("l_suppkey") % 3).alias("dst"), F.col("l_linestatus").alias("dst_kind"), F.lit("data").alias("kind"))
    prints = cut(discovery.dependence_prints(edges))
    after = prints.select((F.col("graph") - 1).alias("graph"), F.col("marks").alias("other"))
    return prints.join(after, "graph", "left").select("graph", F.round(discovery.dependence_score(F.col("marks"), F.col("other")), 9).alias("score"))


def all_similar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes of equal shingle sets whose signatures of 128 minima agree in four of five places or more."""
    docs = cut(minhash.signed_sets(similar.hashes(spark, d), 128))
    first = docs.groupBy("digest").agg(F.min("id").alias("id")).select("id")
    return discovery.all_similar(docs.join(first, "id", "left_semi").select("id", "sig"), 128, 0.8)


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Live variables and reaching definitions of each block together."""
    out = dataflow.flow(*clone_plans._functions(spark, d))
    return out.select("fn", "block", *[F.array_join(c, ",").alias(c) for c in ("live_in", "live_out", "reaching")])


QUERIES = {
    "c6_class_lengths": class_lengths, "c8_maximal_repeats": maximal_repeats, "c16_incremental": incremental_classes, "c10_subtrees": subtrees, "a11_stale": stale, "u8_index_unused": index_unused, "g13_index_report": index_report,
    "a9_statistics": corpus_statistics, "e3_discovery": discovered, "e9_presets": reranked, "e8_dependence": dependence_scores, "m6_all_similar": all_similar, "d7_flow": flow,
}

_W = clone_plans.WINDOW
_LONG = f"""t AS (SELECT doc_id AS file, regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN}') AS t FROM documents),
w AS (SELECT file, unnest(range(0, len(t) - {_W - 1})) AS start, unnest(list_transform(range(1, len(t) - {_W} + 2), lambda i: md5(array_to_string(t[i:i + {_W} - 1], ' ')))) AS gram FROM t WHERE len(t) >= {_W}),
x AS (SELECT *, lead(gram) OVER f AS a, lag(gram) OVER f AS b FROM w WINDOW f AS (PARTITION BY file ORDER BY start)),
c AS (SELECT gram, count(*) AS occurrences, count(DISTINCT file) AS documents, coalesce(count(a) = count(*) AND min(a) = max(a), false) AS further, NOT coalesce(count(b) = count(*) AND min(b) = max(b), false) AS maximal FROM x GROUP BY gram HAVING count(*) >= 2),
l AS (SELECT c.*, {_W} - start + min(CASE WHEN NOT further THEN start END) OVER (PARTITION BY file ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS length FROM x JOIN c USING (gram)),
g AS (SELECT gram, occurrences, documents, maximal, max(length) AS length FROM l GROUP BY ALL)"""
_SYMBOLS = """o AS (SELECT event_id % 1499 AS usr, event_id // 1499 % 3 AS f, event_type AS e FROM events),
u AS (SELECT usr, count(*) FILTER (e = 'signup') AS defs, count(*) FILTER (e = 'purchase') AS uses, coalesce(len(list_filter(list(DISTINCT f) FILTER (e = 'purchase'), lambda x: NOT list_contains(coalesce(list(DISTINCT f) FILTER (e = 'signup'), []), x))), 0) AS away FROM o GROUP BY usr),
s AS (SELECT c_custkey AS usr, CASE WHEN c_custkey % 31 = 0 THEN 'init' WHEN c_custkey % 29 = 0 THEN '$' || c_custkey WHEN c_custkey % 5 = 0 THEN 'test' || c_custkey ELSE 's' || c_custkey END AS name, ['class', 'method', 'property', 'extension'][c_custkey % 4 + 1] AS kind,
['class', 'function', 'variable', 'symbol'][c_custkey % 4 + 1] AS word, CASE WHEN c_custkey % 2 = 0 THEN 'Tests/f' ELSE 'Sources/f' END || c_custkey % 9 AS file, c_custkey AS line FROM customer WHERE c_custkey % 23 <> 0)"""
_MARKS = """e AS (SELECT l_orderkey AS g, l_partkey % 3 AS s, l_suppkey % 3 AS t, 'e:' || l_returnflag || '|' || l_linestatus || '|data' AS m FROM lineitem),
n AS (SELECT g, 'n:' || sum(i) || '|' || sum(o) AS m FROM (SELECT g, s AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT g, t, 1, 0 FROM e) GROUP BY g, node), p AS (SELECT g, list(DISTINCT m) AS m FROM (SELECT g, m FROM e UNION ALL SELECT g, m FROM n) GROUP BY g)"""

ORACLES = {
    "c6_class_lengths": f"WITH {_LONG} SELECT gram, occurrences, documents, length FROM g",
    "c8_maximal_repeats": f"WITH {_LONG} SELECT gram, occurrences, length FROM g WHERE maximal",
    "c16_incremental": clone_plans.ORACLES["c7_exact_classes"],
    "c10_subtrees": """WITH n AS (SELECT l_orderkey AS tree, l_linenumber AS pre, min(l_suppkey) % 3 AS depth, min(l_returnflag) AS kind FROM lineitem GROUP BY ALL),
r AS (SELECT *, (SELECT min(b.pre) FROM n b WHERE b.tree = a.tree AND b.pre > a.pre AND b.depth <= a.depth) AS stop FROM n a WHERE kind IN ('A', 'R'))
SELECT r.tree, r.pre, r.kind, count(*) AS nodes, md5(string_agg((n.depth - r.depth) || ':' || n.kind, ' ' ORDER BY n.pre)) AS print FROM r JOIN n ON n.tree = r.tree AND n.pre >= r.pre AND (stop IS NULL OR n.pre < stop) GROUP BY r.tree, r.pre, r.kind HAVING count(*) >= 2""",
    "a11_stale": """SELECT o_custkey AS file FROM orders GROUP BY 1 HAVING max(o_orderdate) FILTER (o_orderkey % 2 = 0) IS NULL OR max(o_orderdate) > max(o_orderdate) FILTER (o_orderkey % 2 = 0)""",
    "u8_index_unused": f"""WITH {_SYMBOLS}, f AS (SELECT s.*, uses > 0 AS own FROM s JOIN u USING (usr) WHERE defs > 0 AND away = 0 AND name <> 'init' AND NOT starts_with(name, '$') AND NOT (starts_with(file, 'Tests/') AND starts_with(name, 'test')))
SELECT usr, name, kind, file, line, CASE WHEN own THEN 'onlySelfReferenced' ELSE 'neverReferenced' END AS reason, CASE WHEN own THEN chr(39) || name || chr(39) || ' is only referenced within its own definition' ELSE 'Consider removing unused ' || word || ' ' || chr(39) || name || chr(39) END AS suggestion, 'high' AS confidence FROM f""",
    "g13_index_report": f"""WITH RECURSIVE {graphs._NODES}, {graphs._EDGES}, {graphs._REACH}, m AS (SELECT id, kind, kind = 'part' AND ends_with(id, '7') AS x, id IN (SELECT id FROM reach) AS hit FROM nodes)
SELECT 'total' AS part, 'symbols' AS name, count(*)::DOUBLE AS value FROM m UNION ALL SELECT 'total', 'roots', count(*)::DOUBLE FROM m WHERE id IN ('r0', 'r2') UNION ALL SELECT 'total', 'reachable', count(*)::DOUBLE FROM m WHERE hit UNION ALL SELECT 'total', 'unreachable', count(*)::DOUBLE FROM m WHERE NOT hit AND NOT x
UNION ALL SELECT 'total', 'external', count(*)::DOUBLE FROM m WHERE x UNION ALL SELECT 'total', 'percent', round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*) FILTER (NOT x), 6) FROM m UNION ALL SELECT 'total', 'edges', count(*)::DOUBLE FROM edges
UNION ALL SELECT 'unreachable', kind, count(*)::DOUBLE FROM m WHERE NOT hit AND NOT x GROUP BY kind UNION ALL SELECT 'root', 'publicAPI', 1.0::DOUBLE UNION ALL SELECT 'root', 'mainFunction', 1.0::DOUBLE""",
    "a9_statistics": f"""WITH {graphs._DECL}, {graphs._REFS} SELECT 'files' AS name, count(*) AS value FROM documents UNION ALL SELECT 'lines', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents UNION ALL SELECT 'declarations', count(*) FROM decl
UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'kind:' || kind, count(*) FROM decl GROUP BY kind""",
    "e3_discovery": f"""WITH RECURSIVE {similar._V}, s AS (SELECT q.id AS q, c.id AS i, q.module AS f, c.module AS h, list_cosine_similarity(q.v, c.v) AS x FROM v q JOIN v c ON c.id <> q.id), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x DESC, i) AS n FROM s),
l AS (SELECT least(q, i) AS a, greatest(q, i) AS b, max(x) AS x FROM k WHERE n <= 5 AND x >= {ALIKE} AND NOT (f IS NOT DISTINCT FROM h AND abs(q - i) <= 9) GROUP BY ALL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), z AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT component, count(*) AS members, (SELECT round(avg(x), 6) FROM l JOIN z y ON y.node = l.a WHERE y.component = z.component) AS similarity FROM z GROUP BY component""",
    "e9_presets": f"""WITH {similar._V}, r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY id) AS n FROM v), p AS (SELECT a.module, a.id AS id1, b.id AS id2, list_cosine_similarity(a.v, b.v) + 0.8 AS c, list_distinct(list_transform(a.v, lambda x: CAST(floor(x * 20) AS BIGINT))) AS s,
list_distinct(list_transform(b.v, lambda x: CAST(floor(x * 20) AS BIGINT))) AS t FROM r a JOIN r b ON a.module = b.module AND a.n = 1 AND b.n = 2), j AS (SELECT *, len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) AS j FROM p)
SELECT module, id1, id2, c >= 0.85 AND j >= 0.2 AS balanced, c >= 0.9 AND j >= 0.3 AS strict, c >= 0.8 AND j >= 0.1 AS loose FROM j""",
    "e8_dependence": f"WITH {_MARKS} SELECT a.g AS graph, CASE WHEN b.g IS NULL THEN 1.0 ELSE round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 9) END::DOUBLE AS score FROM p a LEFT JOIN p b ON b.g = a.g + 1",
    "d7_flow": f"""WITH RECURSIVE {clone_plans._FN}, r AS (SELECT e.fn, e.dst AS block, s.d AS v, s.d || '@' || s.block || ':0' AS x FROM e JOIN s ON s.fn = e.fn AND s.block = e.src
UNION SELECT e.fn, e.dst, r.v, r.x FROM r JOIN s ON s.fn = r.fn AND s.block = r.block JOIN e ON e.fn = r.fn AND e.src = r.block WHERE s.d <> r.v),
i AS (SELECT fn, block, string_agg(DISTINCT v, ',' ORDER BY v) AS x FROM live GROUP BY ALL), o AS (SELECT fn, block, string_agg(DISTINCT v, ',' ORDER BY v) AS x FROM outs GROUP BY ALL), q AS (SELECT fn, block, string_agg(DISTINCT x, ',' ORDER BY x) AS x FROM r GROUP BY ALL)
SELECT fn, block, coalesce(i.x, '') AS live_in, coalesce(o.x, '') AS live_out, coalesce(q.x, '') AS reaching FROM s LEFT JOIN i USING (fn, block) LEFT JOIN o USING (fn, block) LEFT JOIN q USING (fn, block)""",
}
