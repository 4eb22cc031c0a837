"""Clones: greedy windows, overlap rules, ignore regions, reports, incremental detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from . import shingled


def windows(df: DataFrame, tokens: Column, size: int, key: str = "file") -> DataFrame:
    """(key, start, gram): every window of `size` tokens, its text hashed (md5 of the tokens joined by spaces)."""
    starts = F.sequence(F.lit(0), F.size("t") - size)
    grams = F.transform(starts, lambda i: F.struct(i.alias("start"), F.md5(F.array_join(F.slice("t", i + 1, size), " ").cast("binary")).alias("gram")))
    return df.select(key, tokens.alias("t")).where(F.size("t") >= size).select(key, F.explode(grams).alias("g")).select(key, "g.start", "g.gram")


def repeated_classes(df: DataFrame, tokens: Column, size: int, key: str = "file") -> DataFrame:
    """(fingerprint, occurrences, documents) of windows of `size` tokens that occur twice or more; the fingerprint is the md5
    of the tokens joined by spaces. Only windows that may be repeated leave their chunk of texts (see shingled)."""
    found = shingled.places(df, tokens, size, key, size - size // 2)
    classes = found.groupBy("a", "b").agg(F.sum("n").alias("occurrences"), F.sum("documents").alias("documents")).where("occurrences >= 2")
    return classes.select(shingled.hexed().alias("fingerprint"), "occurrences", "documents")


def kept_counts(df: DataFrame, tokens: Column, size: int, key: str = "file") -> DataFrame:
    """(gram, kept) of windows that occur twice or more: how many without_overlaps() keeps. The fold runs within a
    document, so only its counts are moved."""
    found = shingled.places(df, tokens, size, key, size - size // 2)
    kept = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).where("n >= 2")
    return kept.select(shingled.hexed().alias("gram"), "kept")


def greedy_counts(df: DataFrame, tokens: Column, size: int, key: str = "file") -> DataFrame:
    """(gram, groups, members) of greedy_groups(): the first window's group, which has all but those that overlap it."""
    found = shingled.places(df, tokens, size, key, size - size // 2)
    first = F.min(F.struct(key, "start", "skipped"))["skipped"]
    groups = found.groupBy("a", "b").agg((F.sum("n") - first).alias("members")).where("members >= 2")
    return groups.select(shingled.hexed().alias("gram"), F.lit(1).cast("long").alias("groups"), "members")


def repeated(found: DataFrame, key: str = "file") -> DataFrame:
    """Windows whose gram occurs twice or more; counts are pre-aggregated and joined back."""
    often = found.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2").select("gram")
    return found.join(often, "gram").select(key, "start", "gram")


def without_overlaps(found: DataFrame, size: int, key: str = "file", least: int = 1) -> DataFrame:
    """Of a gram's windows in one file those that overlap the last kept one by at most half a window, from the left.
    least: grams with fewer windows are left out.

    The fold runs within one gram of one file. Starts are gathered once; the grams' counts are taken from the same
    exchange and joined back.
    """
    rows = found.groupBy("gram", key).agg(F.sort_array(F.collect_list("start")).alias("starts"))
    if least > 1:
        often = rows.groupBy("gram").agg(F.sum(F.size("starts")).alias("n")).where(F.col("n") >= least).select("gram")
        rows = rows.join(often, "gram")
    gap = size - size // 2

    def step(kept: Column, s: Column) -> Column:
        return F.when((F.size(kept) == 0) | (s - F.coalesce(F.element_at(kept, -1), F.lit(0)) >= gap), F.array_append(kept, s)).otherwise(kept)

    # most grams occur once in a file
    kept = F.when(F.size("starts") == 1, F.col("starts")).otherwise(F.aggregate("starts", F.array().cast("array<int>"), step))
    return rows.select("gram", key, F.explode(kept).alias("start"))


def greedy_groups(found: DataFrame, size: int) -> DataFrame:
    """found(gram, file, start) to (gram, seed, file, start): seed-greedy groups of two windows or more.

    In order of file and start each ungrouped window seeds a group and takes all later ungrouped windows of its gram
    but those that overlap the seed, in its file, by more than half a window. These all overlap each other by as much,
    so none of them seeds a group of two: a gram has one group, that of its first window.
    """
    seeds = found.groupBy("gram").agg(F.min(F.struct("file", "start")).alias("s"))
    near = (F.col("file") == F.col("s.file")) & (F.col("start") != F.col("s.start")) & (size - (F.col("start") - F.col("s.start")) > size // 2)
    group = found.join(seeds, "gram").where(~near)
    often = group.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2").select("gram")
    return group.join(often, "gram").select("gram", F.concat_ws(":", "s.file", "s.start").alias("seed"), F.col("file").cast("long").alias("file"), F.col("start").cast("int").alias("start"))


def pattern_places(df: DataFrame, tokens: Column, patterns: DataFrame, size: int, key: str = "file") -> DataFrame:
    """patterns(pattern_id, gram) found in texts: (pattern_id, key, start). gram as windows() makes it."""
    return windows(df, tokens, size, key).join(patterns, "gram").select("pattern_id", key, "start")


def near_similarity(members: DataFrame) -> DataFrame:
    """members(group, id, tokens) to (group, similarity): mean pairwise Jaccard of their token sets.

    Groups are those of a window; their pairs are summed inside the group's fold.
    """
    sets = members.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("id", "tokens"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: jaccard(a["tokens"], b["tokens"]))))
    mean = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x) / F.size("pairs")
    return sets.where(F.size("m") >= 2).select("group", pairs.alias("pairs")).select("group", mean.alias("similarity"))


def deduplicated(groups: DataFrame) -> DataFrame:
    """groups(group, locations: array<string>): one of the groups with equal sets of locations, the first by name."""
    keyed = groups.withColumn("key", F.array_join(F.array_sort("locations"), "|"))
    order = Window.partitionBy("key").orderBy("group")
    return keyed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("key", "__n")


def report(clones: DataFrame, files: DataFrame) -> DataFrame:
    """clones(group, lines), files(file, lines): groups, duplicated lines (all but one member a group), share of all lines."""
    duplicated = clones.groupBy("group").agg((F.sum("lines") - F.max("lines")).alias("lines")).agg(F.count("*").alias("groups"), F.coalesce(F.sum("lines"), F.lit(0)).alias("duplicated_lines"))
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    percent = F.round(F.coalesce(F.col("duplicated_lines") * 100.0 / F.nullif("total_lines", F.lit(0)), F.lit(0.0)), 6)
    return total.join(duplicated).select("files", "total_lines", "groups", "duplicated_lines", percent.alias("percent"))  # one row each


def ignore_regions(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """lines(file, line, content) to (file, start, stop): from a line that holds `begin` to the next with `end`, else to
    the file's last line. A begin inside an open region is no new one."""
    order = Window.partitionBy("file").orderBy("line")
    marked = lines.withColumn("mark", F.when(F.col("content").contains(begin), 1).when(F.col("content").contains(end), 0))
    marks = marked.where("mark is not null")
    opening = marks.withColumn("before", F.lag("mark").over(order)).where("mark = 1 and coalesce(before, 0) = 0")
    closing = marks.withColumn("before", F.lag("mark").over(order)).where("mark = 0 and before = 1")
    events = opening.select("file", "line", F.lit(1).alias("kind")).unionByName(closing.select("file", "line", F.lit(0).alias("kind")))
    paired = events.withColumn("stop", F.lead("line").over(order)).where("kind = 1")
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    return paired.join(last, "file").select("file", F.col("line").alias("start"), F.coalesce("stop", "last").alias("stop"))


def without_ignored(clones: DataFrame, regions: DataFrame, block: int = 64) -> DataFrame:
    """clones(group, file, start, stop) that overlap no region of their file; groups left with one member go.

    The range join meets on (file, block of lines).
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block).cast("int"), F.floor(F.col(b) / block).cast("int")))
    spread = regions.select("file", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), cells("start", "stop").alias("cell"))
    hit = clones.withColumn("cell", cells("start", "stop")).join(spread, ["file", "cell"]).where("start <= r_stop and stop >= r_start").select("group", "file", "start", "stop").distinct()
    kept = clones.join(hit, ["group", "file", "start", "stop"], "left_anti")
    left = kept.groupBy("group").agg(F.count("*").alias("n")).where("n >= 2").select("group")
    return kept.join(left, "group", "left_semi").select("group", "file", "start", "stop")


def fingerprint_groups(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """nodes(hash, root_kind, file, start, node_count): members of equal hash and root kind whose node count is
    `least` or more of the first member's; groups of two or more with the first's place and the mean ratio of pairs."""
    order = Window.partitionBy("hash", "root_kind").orderBy("file", "start")
    first = F.first("node_count").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = nodes.withColumn("first", first).where(F.least("first", "node_count") / F.greatest("first", "node_count") >= least)
    rows = near.groupBy("hash", "root_kind").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("node_count")).alias("c")).where("members >= 2")
    # of sorted counts, pair (i < j) has ratio c[i] / c[j]
    total = F.aggregate(F.transform("c", lambda x, i: F.aggregate(F.slice("c", i + 2, F.size("c")), F.lit(0.0), lambda s, y: s + x / y)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("hash", "root_kind", "members", (total / (F.col("members") * (F.col("members") - 1) / 2)).alias("similarity"))
