"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges(u, v): undirected; self loops and repeated rows are ignored. Returns (node, component) for the
    nodes of edges, component the smallest node reachable. No edges: an empty table.

    Large-star links the larger neighbours of every node to its smallest one, small-star the smaller ones.
    The smallest neighbour is a pre-aggregated min, joined back from a table of its own, so that a node with
    a third of all edges is a skewed join, which Spark deals out anew. Every round is checkpointed.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(edges)) == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).unionByName(roots)
