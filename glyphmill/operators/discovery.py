"""Clones found through vectors, and the scores by which groups are kept or dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .checkpoints import cut
from .graph import components
from .minhash import signature_similarity

#: Least scores of the presets; a score that a preset doesn't name isn't asked for.
PRESETS = {
    "balanced": {"cosine": 0.85, "jaccard": 0.20},
    "strict": {"cosine": 0.90, "jaccard": 0.30, "maxsim": 0.85, "tree": 0.70},
    "loose": {"cosine": 0.80, "jaccard": 0.10},
}


def discovered_pairs(neighbours: DataFrame, places: DataFrame, threshold: float, least_overlap: float = 0.0) -> DataFrame:
    """neighbours(query, id, similarity), places(id, file, start_line, end_line[, words]) to (id1, id2, similarity),
    id1 < id2, each pair once: from the threshold on, no overlapping lines of one file, word sets as alike as
    least_overlap asks. The neighbours' k is applied before these rules."""
    pair = neighbours.where((F.col("similarity") >= threshold) & (F.col("query") != F.col("id")))
    pairs = pair.groupBy(F.least("query", "id").alias("id1"), F.greatest("query", "id").alias("id2")).agg(F.max("similarity").alias("similarity"))
    columns = ["file", "start_line", "end_line", *(["words"] if least_overlap > 0 else [])]
    side = lambda n: places.select(F.col("id").alias(f"id{n}"), *[F.col(c).alias(f"{c}{n}") for c in columns])
    both = pairs.join(side(1), "id1").join(side(2), "id2")
    both = both.where(~(F.col("file1").eqNullSafe(F.col("file2")) & (F.col("start_line1") <= F.col("end_line2")) & (F.col("start_line2") <= F.col("end_line1"))))
    if least_overlap > 0:
        both = both.where(jaccard(F.col("words1"), F.col("words2")) >= least_overlap)
    return both.select("id1", "id2", "similarity")


def discovered_groups(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(id1, id2, similarity) to groups (component, members, similarity: mean of its pairs) and members (component, id)."""
    pairs = cut(pairs)
    found = components(pairs.select(F.col("id1").alias("u"), F.col("id2").alias("v")))
    mean = pairs.join(found, pairs["id1"] == found["node"]).groupBy("component").agg(F.avg("similarity").alias("similarity"))
    groups = found.groupBy("component").agg(F.count("*").alias("members")).join(mean, "component")
    return groups, found.select("component", F.col("node").alias("id"))


def first_two(members: DataFrame, group: str) -> DataFrame:
    """members(group, id) to (group, id1, id2): its two smallest ids; groups of one member are left out."""
    low = members.groupBy(group).agg(F.min("id").alias("id1"))
    rest = members.join(low, group).where(F.col("id") > F.col("id1"))
    return rest.groupBy(group, "id1").agg(F.min("id").alias("id2"))


def accepted(preset: str) -> Column:
    """Whether a row's scores (columns cosine, jaccard, maxsim, tree) reach the preset; a null score, of a step that
    could not be run, does not stand in the way."""
    rules = [F.coalesce(F.col(name) >= least, F.lit(True)) for name, least in PRESETS[preset].items()]
    out = F.lit(True)
    for rule in rules:
        out &= rule
    return out


def dependence_prints(edges: DataFrame) -> DataFrame:
    """edges(graph, src, src_kind, dst, dst_kind, kind) to (graph, marks): the set of its edges' kinds of ends and own
    kind, and of its nodes' in- and out-degrees; names of nodes have no part in it."""
    edge = edges.select("graph", F.concat(F.lit("e:"), F.concat_ws("|", "src_kind", "dst_kind", "kind")).alias("mark")).distinct()
    ends = edges.select("graph", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))).alias("e"))
    degrees = ends.groupBy("graph", "e.node").agg(F.sum("e.into").alias("into"), F.sum("e.out").alias("out"))
    node = degrees.select("graph", F.concat(F.lit("n:"), F.concat_ws("|", "into", "out")).alias("mark")).distinct()
    return edge.unionByName(node).groupBy("graph").agg(F.sort_array(F.collect_set("mark")).alias("marks"))


def dependence_score(a: Column, b: Column) -> Column:
    """Jaccard of two graphs' marks; 0 where both are empty, 1 where either is missing."""
    return F.when(a.isNull() | b.isNull(), 1.0).when((F.size(a) == 0) & (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def all_similar(signatures: DataFrame, n: int, threshold: float) -> DataFrame:
    """signatures(id, sig of n values) to (id1, id2, similarity), id1 < id2, by similarity: exactly the pairs whose
    signatures agree in a share of threshold or more of their places.

    Such a pair differs in n - ceil(threshold * n) places at most, so of one more than as many bands, into which all places
    are cut, it agrees in one whole band; only rows that share a band meet.
    """
    need = math.ceil(threshold * n - 1e-9)
    if need < 1:
        raise ValueError("the threshold must be above 0")
    bands = n - need + 1
    bounds = [n * b // bands for b in range(bands + 1)]
    usable = signatures.where(F.size("sig") == n).select("id", "sig")
    # a band's hash may stand for two bands, which costs a pair that is left out below
    keyed = usable.select("id", F.posexplode(F.array(*[F.xxhash64(F.slice("sig", a + 1, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])).alias("band", "value"))
    met = keyed.select(F.col("id").alias("id1"), "band", "value").join(keyed.select(F.col("id").alias("id2"), "band", "value"), ["band", "value"]).where("id1 < id2").select("id1", "id2").distinct()
    side = lambda k: usable.select(F.col("id").alias(f"id{k}"), F.col("sig").alias(f"s{k}"))
    both = met.join(side(1), "id1").join(side(2), "id2").select("id1", "id2", signature_similarity(F.col("s1"), F.col("s2")).alias("similarity"))
    return both.where(F.col("similarity") >= threshold).orderBy(F.col("similarity").desc(), "id1", "id2")
