"""Long repeats, cached tokens, subtrees, index and discovery against naive versions; odd inputs."""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import checkpoints, clones, dataflow, discovery, indexed, repeats


def _split(c):
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def _naive_repeats(texts, size):
    places = defaultdict(list)
    for f, t in texts.items():
        for i in range(len(t) - size + 1):
            places[tuple(t[i : i + size])].append((f, i))
    out = {}
    for gram, at in places.items():
        if len(at) < 2:
            continue
        n = size
        while len({texts[f][i + n] if i + n < len(texts[f]) else (f, i) for f, i in at}) == 1:
            n += 1
        before = {texts[f][i - 1] if i else (f, i) for f, i in at}
        out[" ".join(gram)] = (len(at), len({f for f, _ in at}), n, len(before) > 1)
    return out


def test_repeat_lengths(spark):
    draw = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: [str(x) for x in draw.integers(0, 4, 60)] for i in range(6)}
    texts |= {10: ["a", *passage, "b"], 11: ["c", *passage, "d"], 12: passage[:25], 13: ["z"] * 50, 14: ["z"] * 20}
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(20, None), (21, ""), (22, "p1 p2")]
    found = {r.gram: (r.occurrences, r.documents, r.length, r.maximal) for r in repeats.repeat_groups(spark.createDataFrame(rows, "file long, text string"), _split(F.col("text")), 3).collect()}
    want = {hashlib.md5(g.encode()).hexdigest(): v for g, v in _naive_repeats(texts, 3).items()}
    assert found == want
    empty = spark.createDataFrame([], "file long, text string")
    assert repeats.repeat_groups(empty, _split(F.col("text")), 3).count() == 0


def test_only_changed_files_are_read_anew(spark):
    files = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None), (4, "e")], "file long, text string")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    cached = files.where("file in (1, 3)").select("file", digest.alias("hash"), F.array(F.lit("kept")).alias("tokens"))
    cached = cached.unionByName(cached).unionByName(spark.createDataFrame([(2, "old", ["x"]), (9, "gone", ["y"])], "file long, hash string, tokens array<string>"))
    out = {r.file: (r.tokens, r.reused) for r in repeats.refreshed_tokens(files, cached, _split).collect()}
    assert out == {1: (["kept"], True), 2: (["c", "d"], False), 3: (["kept"], True), 4: (["e"], False)}


def test_subtrees(spark):
    shape = [(0, "f"), (1, "a"), (2, "b"), (1, "c")]
    nodes = [(t, i, d + shift, k) for t, shift in ((1, 0), (2, 3)) for i, (d, k) in enumerate(shape)] + [(3, 0, 0, "f"), (3, 1, 1, "a"), (3, 2, 1, "b"), (3, 3, 1, "c"), (4, 0, 0, "f"), (4, 1, 0, "f"), (4, 2, 1, "a")]
    out = repeats.subtree_prints(spark.createDataFrame(nodes, "tree long, pre int, depth int, kind string"), ["f"], 2).collect()
    by = {(r.tree, r.pre): (r.nodes, r.print) for r in out}
    assert {k: v[0] for k, v in by.items()} == {(1, 0): 4, (2, 0): 4, (3, 0): 4, (4, 1): 2}
    assert by[1, 0] == by[2, 0] != by[3, 0]


def test_index_mode_and_staleness(spark):
    assert indexed.analysis_mode("simple", "available") == ("reachability", "userRequested")
    assert indexed.analysis_mode("indexStore", "stale") == ("indexStore", None)
    assert indexed.analysis_mode("indexStore", "available", hybrid=True) == ("hybrid", None)
    assert [indexed.analysis_mode("indexStore", s)[1] for s in ("notFound", "failed")] == ["noIndexStore", "indexStoreFailed"]
    sources = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", None)], "file string, modified long")
    units = spark.createDataFrame([("a", 4), ("a", 6), ("b", 4)], "file string, modified long")
    assert sorted(r.file for r in indexed.stale_files(sources, units).collect()) == ["b", "c"]


def test_index_detector(spark):
    occurrences = spark.createDataFrame([(1, "f", 2), (2, "f", 2), (2, "f", 4), (3, "f", 2), (3, "g", 4), (4, "f", 4), (5, "f", 2), (6, "f", 2), (7, "t", 2)], "usr long, file string, roles int")
    named = [(1, "a", "method", False), (2, "b", "struct", False), (3, "c", "class", False), (4, "d", "class", False), (5, "deinit", "method", False), (6, "s", "class", True), (7, "testX", "method", False)]
    symbols = spark.createDataFrame([(*r, "t" if r[0] == 7 else "f", 1) for r in named], "usr long, name string, kind string, system boolean, file string, line long")
    out = {r.usr: (r.reason, r.suggestion, r.confidence) for r in indexed.index_unused(occurrences, symbols, 2, 4, test_file=F.col("file") == "t").collect()}
    assert out == {1: ("neverReferenced", "Consider removing unused function 'a'", "high"), 2: ("onlySelfReferenced", "'b' is only referenced within its own definition", "high")}


def test_index_report_without_own_symbols(spark):
    nodes = spark.createDataFrame([("x", "class", True, None)], "id string, kind string, external boolean, root_reason string")
    out = {(r.part, r.name): r.value for r in indexed.index_report(nodes, spark.createDataFrame([], "src string, dst string")).collect()}
    assert out["total", "percent"] == 100 and out["total", "symbols"] == 1 and out["total", "unreachable"] == 0


def test_discovered_pairs(spark):
    near = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.95), (1, 3, 0.95), (2, 4, 0.5), (3, 4, 0.97), (5, 5, 1.0)], "query long, id long, similarity double")
    places = spark.createDataFrame([(1, "f", 1, 9, ["a", "b"]), (2, "f", 10, 20, ["a"]), (3, "f", 5, 8, ["a", "b"]), (4, "g", 1, 9, ["z"]), (5, "h", 1, 1, ["q"])], "id long, file string, start_line int, end_line int, words array<string>")
    pairs = discovery.discovered_pairs(near, places, 0.9)
    assert sorted((r.id1, r.id2) for r in pairs.collect()) == [(1, 2), (3, 4)]
    assert [(r.id1, r.id2) for r in discovery.discovered_pairs(near, places, 0.9, 0.5).collect()] == [(1, 2)]
    groups, members = discovery.discovered_groups(pairs)
    assert sorted((r.component, r.members, r.similarity) for r in groups.collect()) == [(1, 2, 0.95), (3, 2, 0.97)]
    assert sorted((r.component, r.id) for r in members.collect()) == [(1, 1), (1, 2), (3, 3), (3, 4)]


def test_presets(spark):
    rows = [(0.86, 0.2, None, None), (0.9, 0.3, 0.85, 0.7), (0.9, 0.3, 0.84, 0.7), (0.95, 0.5, None, None), (0.8, 0.05, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cosine double, jaccard double, maxsim double, tree double").select(*[discovery.accepted(p).alias(p) for p in ("balanced", "strict", "loose")])
    assert [tuple(r) for r in df.collect()] == [(True, False, True), (True, True, True), (True, False, True), (True, True, True), (False, False, False)]


def test_dependence_scores(spark):
    edges = [(1, "a", "v", "b", "b", "data"), (1, "b", "b", "c", "v", "control"), (2, "x", "v", "y", "b", "data"), (2, "y", "b", "z", "v", "control"), (3, "a", "v", "b", "b", "data")]
    prints = {r.graph: r.marks for r in discovery.dependence_prints(spark.createDataFrame(edges, "graph long, src string, src_kind string, dst string, dst_kind string, kind string")).collect()}
    assert prints[1] == prints[2] == ["e:b|v|control", "e:v|b|data", "n:0|1", "n:1|0", "n:1|1"] and prints[3] == ["e:v|b|data", "n:0|1", "n:1|0"]
    pairs = [(prints[1], prints[2]), (prints[1], prints[3]), (prints[1], None), ([], [])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(discovery.dependence_score(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == pytest.approx([1.0, 0.6, 1.0, 0.0])


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_all_similar(spark, threshold):
    n, draw = 10, np.random.default_rng(8)
    base = draw.integers(0, 9, (5, n))
    sigs = {i: [int(base[i % 5][j]) if draw.random() < 0.85 else int(draw.integers(100, 999)) for j in range(n)] for i in range(40)}
    df = spark.createDataFrame([*sigs.items(), (99, None), (98, [])], "id long, sig array<long>")
    want = {(a, b): sum(x == y for x, y in zip(sigs[a], sigs[b], strict=True)) / n for a, b in combinations(sorted(sigs), 2)}
    found = {(r.id1, r.id2): r.similarity for r in discovery.all_similar(df, n, threshold).collect()}
    assert found == {k: v for k, v in want.items() if v >= threshold}


def test_checkpoint_folder_on_a_cluster():
    assert checkpoints.folder("spark://host:7077", "/shared") == checkpoints.folder("local[4]", "/shared") == "/shared"
    assert checkpoints.folder("local[4]", None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            checkpoints.folder(master, None)


def test_control_flow(spark):
    """One function with every kind of statement, and one without statements in its loop."""
    # block, parent, slot, idx, kind
    rows = [
        ("a", None, None, 0, "plain"), ("g", None, None, 1, "guard"), ("g1", "g", "else", 0, "return"), ("w", None, None, 2, "while"),
        ("i", "w", "body", 0, "if"), ("i1", "i", "then", 0, "break"), ("i2", "i", "else", 0, "continue"), ("j", "w", "body", 1, "plain"),
        ("s", None, None, 3, "switch"), ("c1", "s", "case", 0, "case"), ("c1a", "c1", "body", 0, "fallthrough"), ("c2", "s", "case", 1, "case"),
        ("c2a", "c2", "body", 0, "plain"), ("c3", "s", "case", 2, "default"), ("d", None, None, 4, "do"), ("d1", "d", "body", 0, "throw"),
        ("d2", "d", "catch", 0, "catch"), ("d2a", "d2", "body", 0, "defer"), ("r", None, None, 5, "repeat"), ("r1", "r", "body", 0, "plain"), ("t", None, None, 6, "throw"),
    ]
    df = spark.createDataFrame([(1, *x) for x in rows] + [(2, "f", None, None, 0, "for")], "fn long, block string, parent string, slot string, idx int, kind string")
    got = {(r.fn, r.src, r.dst) for r in dataflow.control_flow(df.repartition(3)).collect()}
    one = "entry-a a-g g-w g-g1 g1-exit w-i w-s i-i1 i-i2 i1-s i2-w j-w s-c1 s-c2 s-c3 c1-c1a c1a-c2a c2-c2a c2a-d c3-d d-d1 d-d2 d1-d2 d2-d2a d2a-r1 r1-r r-r1 r-t t-exit"
    assert got == {(1, *x.split("-")) for x in one.split()} | {(2, "entry", "f"), (2, "f", "f"), (2, "f", "exit")}
    assert dataflow.control_flow(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_window_counts_over_chunks(spark, size):
    """Classes, kept windows and greedy groups equal the operators on all windows; only counts leave a document."""
    draw = np.random.default_rng(5)
    texts = {i: [str(x) for x in draw.integers(0, 3, int(n))] for i, n in enumerate(draw.integers(0, 40, 30))} | {40: ["é"] * 90, 41: ["é"] * 4, 42: ["o", "ß"] * 30}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [(50, None), (51, "")], "file long, text string")
    found = clones.windows(df, _split(F.col("text")), size)
    kept = {r.gram: r["count"] for r in clones.without_overlaps(found, size, least=2).groupBy("gram").count().collect()}
    assert {r.gram: r.kept for r in clones.kept_counts(df, _split(F.col("text")), size).collect()} == kept
    greedy = {r.gram: (r.groups, r.members) for r in clones.greedy_groups(found, size).groupBy("gram").agg(F.count_distinct("seed").alias("groups"), F.count("*").alias("members")).collect()}
    assert {r.gram: (r.groups, r.members) for r in clones.greedy_counts(df, _split(F.col("text")), size).collect()} == greedy
    classes = {r.gram: (r.n, r.d) for r in found.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("file").alias("d")).where("n >= 2").collect()}
    assert {r.fingerprint: (r.occurrences, r.documents) for r in clones.repeated_classes(df, _split(F.col("text")), size).collect()} == classes
    assert clones.kept_counts(df.limit(0), F.split("text", " "), size).count() == 0
