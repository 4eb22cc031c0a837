"""Repeats of variable length, and clones of a corpus of which some files are unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingled


def repeat_groups(df: DataFrame, tokens: Column, size: int, key: str = "file") -> DataFrame:
    """(gram, occurrences, documents, length, maximal) of windows of `size` tokens that occur twice or more.

    length: tokens that all occurrences of the window share from its start on, its own `size` at least. maximal: not
    all occurrences follow on one and the same window, so that none of them can be extended to the left together.
    Texts without tokens, or shorter than a window, have no rows; repeats don't run over a text's end.

    A class is one step longer where all its occurrences go on with one window, which then is a class too, so the steps
    are counted within one of its documents, once it is known of each class whether it goes on.
    """
    return shingled.lengths(df, tokens, size, key).select(shingled.hexed().alias("gram"), "occurrences", "documents", "length", "maximal")


def refreshed_tokens(files: DataFrame, cached: DataFrame, extract) -> DataFrame:
    """files(file, text), cached(file, hash, tokens) to (file, hash, tokens, reused): cached rows whose hash is that of
    the file's text stay, others are extracted anew by extract(Column); files that are gone have no row.

    A null text is an empty one. Of several cached rows of one file and hash one is taken.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = files.select("file", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("hash"))
    known = cached.select("file", "hash", "tokens").dropDuplicates(["file", "hash"])
    kept = known.join(hashed.select("file", "hash"), ["file", "hash"], "left_semi").withColumn("reused", F.lit(True))
    anew = hashed.join(known.select("file", "hash"), ["file", "hash"], "left_anti")
    return kept.unionByName(anew.select("file", "hash", extract(F.col("text")).alias("tokens"), F.lit(False).alias("reused")))


def subtree_prints(nodes: DataFrame, roots: list[str], least: int) -> DataFrame:
    """nodes(tree, pre, depth, kind) in preorder to (tree, pre, kind, nodes, print): subtrees under nodes of the kinds
    `roots` with `least` nodes or more; equal prints mean equal kinds in equal shape.

    A subtree is the run of deeper nodes after its root; its print is the digest of their kinds and relative depths.
    Nodes of one tree, a file, are gathered in one row.
    """
    node = F.struct("pre", "depth", "kind")
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("t"))
    placed = trees.select("tree", "t", F.posexplode("t").alias("i", "root")).where(F.col("root.kind").isin(*roots))
    rest = F.slice("t", F.col("i") + 2, F.size("t"))
    # nodes up to the first that is no deeper than the root
    first_out = F.array_position(F.transform(rest, lambda x: x["depth"] <= F.col("root.depth")), True)
    size = F.when(first_out > 0, first_out).otherwise(F.size("t") - F.col("i")).cast("int")
    sized = placed.withColumn("nodes", size).where(F.col("nodes") >= least)
    shape = F.transform(F.slice("t", F.col("i") + 1, F.col("nodes")), lambda x: F.concat((x["depth"] - F.col("root.depth")).cast("string"), F.lit(":"), x["kind"]))
    return sized.select("tree", F.col("root.pre").alias("pre"), F.col("root.kind").alias("kind"), "nodes", F.md5(F.array_join(shape, " ").cast("binary")).alias("print"))
