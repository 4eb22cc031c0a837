"""Operators against naive versions, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import config
from glyphmill.functions import patterns, text
from glyphmill.operators import clones, dataflow, embeddings, graph, incremental, minhash, reports, symbols
from glyphmill.sources import files
from glyphmill.streaming import pipelines


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_fnv(spark):
    words = ["", "a", "foobar", "é😀", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(text.fnv1a(F.col("w").cast("binary")).alias("h"))
    assert [r.h for r in df.collect()] == [fnv(w.encode()) for w in words]


def test_hashed_grams(spark):
    rows = embeddings.hashed_grams(spark.createDataFrame([(1, "abcabc"), (2, "ab")], "id long, text string"), 128).collect()
    want = {}
    for i in range(4):
        b = fnv("abcabc"[i : i + 3].encode()) % 128
        want[b] = want.get(b, 0) + 1
    assert {r.bucket: r.n for r in rows} == want


def test_positional_form_is_per_block(spark):
    items = [("identifier", "b"), ("operator", "="), ("identifier", "a"), ("literal", "3"), ("identifier", "b")]
    df = spark.createDataFrame([(items,)], "i array<struct<kind:string,text:string>>").select(text.positional(F.col("i")).alias("p"))
    assert list(df.first().p) == ["$ID0", "=", "$ID1", "$LIT0", "$ID0"]


@pytest.mark.parametrize("glob, path, hit", [("**/Tests/**", "a/Tests/b", True), ("*.swift", "a/b.swift", False), ("a?c", "abc", True), ("**/*.swift", "x.swift", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(patterns.matches_glob(F.lit(path), glob).alias("x")).first().x is hit


def test_patterns():
    assert patterns.required_trigrams("fetchUser.*Name") and patterns.required_trigrams("abc|def") == [] and patterns.required_trigrams("ab") == []
    assert "fet" in patterns.required_trigrams("^fetch")
    for bad in ("(a+)+", "x" * 600, "((a*)b)*"):
        with pytest.raises(ValueError):
            patterns.checked(bad)
    assert patterns.checked("(ab)+[*+]?") == "(ab)+[*+]?"


def test_query_strings():
    P = symbols.Pattern
    assert symbols.parse("fetch") == P("name", "fetch") and symbols.parse("A.B<C.D>.x") == P("qualified", "x", ("A", "B<C.D>"))
    assert symbols.parse("T.fetch(id:_:)") == P("qualified_selector", "fetch", ("T",), ("id", None)) and symbols.parse("f()") == P("selector", "f")
    assert symbols.parse("s:4main") == P("usr", "s:4main") and symbols.parse("/a.*b/") == P("regex", "a.*b")
    for bad in ("", "f(id)", "."):
        with pytest.raises(ValueError):
            symbols.parse(bad)
    usr = symbols.decode_usr("s:4main7fetcherV3runyyFZ")
    assert (usr["context"], usr["name"], usr["static"]) == ("main", "fetcher", True)
    kinds = {"s:4mainC1xvp": "property", "s:4mainC1xfC": "method", "s:4mainC1xfc": "method", "s:4mainC1xcc": "initializer", "s:4mainC1xFC": "function", "s:4mainC": "type", "s:4mainV": "struct", "s:4mainF": "unknown", "s:6ClassFF": "unknown"}
    assert {u: symbols.decode_usr(u)["kind"] for u in kinds} == kinds


def test_documentation_forms(spark):
    comments = ["/// One.\n/// Two.\n///\n/// Three.", "- Returns: x", None, "", "/**\n * Sum\n - Note: a\n b\n - Throws: t\n c\n - Note: d\n - Returns: r\n - Returns: s\n*/", "- parameter p q: text: more\n- parameter none"]
    df = spark.createDataFrame(list(enumerate(comments)), "id int, comment string")
    got = {r.id: tuple(r)[1:] for r in reports.documentation(df).collect()}
    assert got == {
        0: ("One. Two.", [], None, None, []), 1: (None, [], "x", None, []), 2: (None, [], None, None, []), 3: (None, [], None, None, []),
        4: ("Sum", [], "s", "t", ["a b c", "d "]), 5: (None, ["p q: text: more"], None, None, []),
    }


def test_closure_of_cycles_loops_and_unknown_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "y"), ("c", "gone"), (None, "q")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in graph.reachable(edges, roots).collect()} == {"a", "b", "c", "gone"}
    assert graph.reachable(edges, roots.limit(0)).count() == 0
    assert {r.id for r in graph.affected(edges, spark.createDataFrame([("c",)], "id string")).collect()} == {"a", "b", "c"}


def test_repartitioning_changes_nothing(spark):
    rnd = random.Random(3)
    edges = spark.createDataFrame([(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)], "u long, v long")
    assert sorted(graph.components(edges.repartition(1)).collect()) == sorted(graph.components(edges.repartition(17)).collect())


def test_greedy_groups_equal_naive(spark):
    rnd = random.Random(2)
    rows = sorted({("g", rnd.randrange(3), rnd.randrange(60)) for _ in range(40)})
    got = clones.greedy_groups(spark.createDataFrame(rows, "gram string, file long, start int"), 10).collect()
    seen, want = set(), set()
    for i, (_, f, s) in enumerate(rows):
        if (f, s) in seen:
            continue
        group = [(f, s)]
        for _, f2, s2 in rows[i + 1 :]:
            if (f2, s2) not in seen and not (f2 == f and 10 - abs(s2 - s) > 5):
                group.append((f2, s2))
        if len(group) > 1:
            seen |= set(group)
            want |= {(f"{f}:{s}", *m) for m in group}
        else:
            seen.add((f, s))
    assert {(r.seed, r.file, r.start) for r in got} == want


def test_all_equal_tokens_keep_half_overlaps(spark):
    df = spark.createDataFrame([(1, ["x"] * 25)], "file long, t array<string>")
    found = clones.without_overlaps(clones.repeated(clones.windows(df, F.col("t"), 10)), 10)
    assert sorted(r.start for r in found.collect()) == [0, 5, 10, 15]
    assert clones.windows(df, F.col("t"), 26).count() == 0 and clones.windows(df, F.col("t"), 25).count() == 1


def test_ignore_regions(spark):
    lines = spark.createDataFrame([(1, i, c) for i, c in enumerate(["a", "BEGIN", "BEGIN", "END", "b", "END", "BEGIN", "c"], 1)], "file long, line int, content string")
    assert sorted((r.start, r.stop) for r in clones.ignore_regions(lines, "BEGIN", "END").collect()) == [(2, 4), (7, 8)]


def test_bands_and_rows():
    assert [minhash.bands_and_rows(256, t) for t in (0.5, 0.7, 0.8, 0.85, 0.95)] == [(43, 5), (26, 9), (19, 13), (15, 17), (7, 36)]


def test_signatures_estimate_jaccard(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(62) for _ in range(400)]
    rows = [(1, base[:300]), (2, base[100:]), (3, [])]
    signed = spark.createDataFrame(rows, "id long, hashes array<bigint>").select("id", minhash.signature(F.col("hashes"), 256).alias("sig"))
    a, b, none = (r.sig for r in signed.orderBy("id").collect())
    assert abs(sum(x == y for x, y in zip(a, b, strict=True)) / 256 - 0.5) < 0.12 and set(none) == {-1}


def tree(labels, parents):
    """Post-order arrays of a tree given by post-order parents (-1: root)."""
    left = []
    for i in range(len(labels)):
        kids = [k for k in range(i) if parents[k] == i]
        left.append(left[kids[0]] if kids else i)
    return {"labels": labels, "left_leaf": left}


def test_tree_distance(spark):
    a, b = tree(list("abc"), [2, 2, -1]), tree(list("adc"), [2, 2, -1])
    assert embeddings.tree_distance(a, a) == 0 and embeddings.tree_distance(a, b) == 1 and embeddings.tree_distance(a, tree([], [])) == 3
    assert embeddings.tree_distance(tree(list("dcabef"), [1, 3, 3, 5, 5, -1]), tree(list("dabcef"), [3, 2, 3, 5, 5, -1])) in (2, 3)
    t = "struct<labels:array<string>,left_leaf:array<int>>"
    row = spark.createDataFrame([((a["labels"], a["left_leaf"]), (b["labels"], b["left_leaf"]))], f"a {t}, b {t}").select(embeddings.tree_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert abs(row.s - 2 / 3) < 1e-9


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "a array<double>, z array<double>, m array<array<double>>, n array<array<double>>")
    r = df.select(embeddings.cosine(F.col("a"), F.col("a")).alias("one"), embeddings.cosine(F.col("a"), F.col("z")).alias("zero"), embeddings.max_sim(F.col("m"), F.col("n")).alias("sim")).first()
    assert (r.one, r.zero, r.sim) == (1.0, 0.0, 0.75)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (120, 5)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.query, r.rank): r.id for r in embeddings.nearest(df, df.where("id < 30"), 4, block=8).collect()}
    n = np.linalg.norm(v, axis=1)
    for q in range(30):
        s = np.divide(v @ v[q], n * n[q], out=np.zeros(120), where=n * n[q] > 0)
        best = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:4]
        assert np.allclose(s[[got[q, r + 1] for r in range(4)]], s[best])


def test_constants_find_dead_branches(spark):
    # entry: x = true; y = 2; branch x -> a (true), b (false); a: z = y + y -> end; b -> end
    s = [("entry", 0, [], ["x"], "const", "true"), ("entry", 1, [], ["y"], "const", "2"), ("entry", 2, ["x"], [], "branch", None), ("a", 0, ["y", "y"], ["z"], "add", None), ("b", 0, [], ["z"], "const", "9"), ("end", 0, ["z"], [], "other", None)]
    e = [("entry", "a", "true"), ("entry", "b", "false"), ("a", "end", None), ("b", "end", None)]
    statements = spark.createDataFrame([(1, *r) for r in s], "fn long, block string, idx int, uses array<string>, defs array<string>, op string, value string")
    edges = spark.createDataFrame([(1, *r) for r in e], "fn long, src string, dst string, label string")
    out = dataflow.constants(statements, edges)
    rows = {r.block: r for r in out.collect()}
    assert not rows["b"].reachable and rows["end"]["values"] == {"x": "true", "y": "2", "z": "4"}
    assert [r.block for r in dataflow.dead_branches(out).collect()] == ["b"]
    reach = dataflow.reaching_definitions(statements, edges)
    assert dataflow.uninitialised_uses(statements, reach).count() == 0
    assert {(r.definition, r.block) for r in dataflow.def_use_chains(statements, reach).collect()} == {("y@entry:1", "a"), ("z@a:0", "end"), ("z@b:0", "end")}
    assert dataflow.reverse_post_order(["entry", "a", "b", "end"], {"entry": ["a", "b"], "a": ["end"], "b": ["end"]}, "entry")[0] == "entry"


def test_notes_join_their_graver_neighbour(spark):
    rows = [("f", 1, 1, "error", "e"), ("f", 3, 1, "note", "n"), ("f", 20, 1, "note", "far"), ("g", 1, 1, "warning", "w")]
    got = {(r.file, r.message): list(r.notes) for r in incremental.with_notes(spark.createDataFrame(rows, "file string, line int, col int, severity string, message string")).collect()}
    assert got == {("f", "e"): ["n"], ("f", "far"): [], ("g", "w"): []}


SOURCE = '''import Foundation
// analysis:ignore
func unusedOne() { let x = 1 }
public struct Shop {
    static var open = "a // b"
    func sell(id: Int) { helper(id) }
}
func helper(_ n: Int) { print(n) }
'''


def test_lexical_front_end(spark, tmp_path):
    (tmp_path / "Sources").mkdir()
    (tmp_path / ".build").mkdir()
    (tmp_path / "Sources/a.swift").write_text(SOURCE)
    (tmp_path / ".build/b.swift").write_text(SOURCE)
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 1 and files.codebase_info(found).first().lines == 9
    declared = {r.name: r for r in files.declaration_table(found).collect()}
    assert declared["Shop"].access == "public" and declared["Shop"].end_line == 7 and declared["sell"].parent_id == declared["Shop"].scope_id
    assert declared["unusedOne"].ignore_directives == ["all"] and declared["helper"].kind == "function"
    references = {(r.identifier, r.context) for r in files.reference_table(files.token_table(found)).collect()}
    assert ("helper", "call") in references and ("unusedOne", "call") not in references


def test_intermediate_blocks(spark):
    content = ["sil @f : $() {", "bb0:", "  cond_br %0, bb1, bb2", "bb1:", "  br bb2", "bb2:", "  return %1"]
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate(content)], "file string, line int, content string")
    assert {(r.block, r.successor) for r in files.intermediate_blocks(df).collect()} == {("bb0", "bb1"), ("bb0", "bb2"), ("bb1", "bb2")}


def test_settings(tmp_path):
    (tmp_path / config.NAME).write_text('{"format": "json", "unused": {"mode": "simple", "minConfidence": "high"}}')
    (tmp_path / "a/b").mkdir(parents=True)
    s = config.load(config.find(tmp_path / "a/b"))
    assert s.unused.mode == "simple" and s.unused.min_confidence == "high" and config.merged(s, unused_mode=None, duplicates_min_tokens=5).duplicates.min_nodes == 1
    for bad in ('{"unused": {"mode": "x"}}', '{"typo": 1}'):
        (tmp_path / config.NAME).write_text(bad)
        with pytest.raises(ValueError):
            config.load(tmp_path / config.NAME)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, f"v{i}") for i in range(20)], "k long, v string")
    for i in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pipelines.read(spark, str(tmp_path / "in"), df.schema)
    query = pipelines.deduplicated(stream, ["k"]).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 5

    def step(batch, state):
        counts = batch.groupBy("k").count()
        return (counts.unionByName(state) if state else counts).groupBy("k").agg(F.sum("count").alias("count"))

    pipelines.incremental(stream, step, str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination(120)
    assert {r["count"] for r in spark.read.parquet(str(tmp_path / "state/batch=1")).collect()} == {8}


def test_pairs_of_fingerprints(spark):
    counts = [10, 9, 12, 3]
    nodes = spark.createDataFrame([("h", "k", i, 0, c) for i, c in enumerate(counts)], "hash string, root_kind string, file long, start int, node_count int")
    near = [10, 9, 12]
    want = np.mean([min(a, b) / max(a, b) for a, b in itertools.combinations(near, 2)])
    row = clones.fingerprint_groups(nodes).first()
    assert row.members == 3 and abs(row.similarity - want) < 1e-9
