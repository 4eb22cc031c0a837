"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has CELLS cells. Every shard owns `virtual_nodes` of them, at hashed places; a key belongs to
the next owned cell clockwise. A shard takes at most its capacity of its own keys; keys that overflow
continue clockwise to the next shard with room. Capacities are the row count dealt evenly (counts at
most one apart), so the law is `rows`, and only as many keys move as exceed a capacity.

Only counts by virtual node (a table of shards * virtual_nodes rows, whatever the input) are gathered;
the walk around the ring is one fold over them. Rows are numbered within virtual nodes, never within
shards or sources, so neither a hot source nor a group of copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, without

#: Cells of the ring; the map from cell to shard is broadcast and holds CELLS short rows.
CELLS = 1 << 14
SHARDS = 40
VIRTUAL_NODES = 64


def ring(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """One row a cell: cell, node (index of the virtual node clockwise from it), home (its shard).
    Of virtual nodes that share a cell the one of the smallest shard stays."""
    places = (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") / virtual_nodes).cast("int").alias("home"), (F.col("id") % virtual_nodes).alias("copy"))
        .select("home", F.pmod(F.xxhash64(F.lit("virtual node"), "home", "copy"), F.lit(CELLS)).cast("int").alias("cell"))
        .groupBy("cell")
        .agg(F.min("home").alias("home"))
    )
    nodes = F.sort_array(F.collect_list(F.struct("cell", "home")))
    # The first node owns also what lies after the last: the ring closes.
    spans = F.transform(
        F.col("nodes"),
        lambda n, i: F.struct(
            i.alias("node"), n["home"].alias("home"), n["cell"].alias("to"),
            F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("nodes"), i - 1)["cell"]).alias("after"),
        ),
    )
    spanned = places.agg(nodes.alias("nodes")).select(F.explode(spans).alias("s"), F.element_at("nodes", -1)["cell"].alias("last"))
    own = spanned.select(F.explode(F.sequence(F.col("s.after") + 1, F.col("s.to"))).alias("cell"), "s.node", "s.home")
    rest = spanned.where((F.col("s.node") == 0) & (F.col("last") < CELLS - 1)).select(
        F.explode(F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).alias("cell"), "s.node", "s.home"
    )
    return own.unionByName(rest)


def _walk(counts: DataFrame, shards: int) -> DataFrame:
    """counts: node, home, n for every virtual node. Returns node and its segments: rows lo <= rank < hi of
    the node go to the shard, at slots from slot on."""
    total = F.sum("n").over(Window.partitionBy())
    capacity = F.floor(total / shards) + F.when(F.col("home") < total % shards, 1).otherwise(0)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("home").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("capacity") - F.col("before")))
    nodes = (
        counts.withColumn("capacity", capacity).withColumn("before", before).withColumn("keep", kept)
        .withColumn("spare", F.col("capacity") - F.sum("keep").over(Window.partitionBy("home")))
        .withColumn("over_from", F.sum(F.col("n") - F.col("keep")).over(Window.orderBy("node")) - (F.col("n") - F.col("keep")))
    )
    everything = nodes.agg(
        F.sort_array(F.collect_list(F.struct("node", "home", "n", "keep", "over_from"))).alias("nodes"),
        F.transform(
            F.sort_array(F.collect_set(F.struct("home", "spare"))), lambda x: x["spare"]
        ).alias("spare"),
        F.transform(F.sort_array(F.collect_set(F.struct("home"))), lambda x: x["home"]).alias("homes"),
    )
    # Two laps: after them every row has a place, as the capacities add up to all rows.
    start = F.struct(
        F.col("spare").alias("spare"), F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("done"),
        F.lit(None).cast("array<struct<home:int,lo:bigint,hi:bigint>>").alias("taken"),
    )
    start = F.struct(start["spare"].alias("spare"), start["carry"].alias("carry"), start["done"].alias("done"),
                     F.array().cast("array<struct<home:int,lo:bigint,hi:bigint>>").alias("taken"))

    def step(state: Column, node: Column) -> Column:
        pending = state["carry"] + node["over"]
        at = F.array_position(F.col("homes"), node["home"]).cast("int")
        take = F.least(pending, F.element_at(state["spare"], at))
        return F.when(
            (pending == 0) | (take == 0),
            F.struct(state["spare"].alias("spare"), pending.alias("carry"), state["done"].alias("done"), state["taken"].alias("taken")),
        ).otherwise(
            F.struct(
                F.transform(state["spare"], lambda x, i: F.when(i + 1 == at, x - take).otherwise(x)).alias("spare"),
                (pending - take).alias("carry"), (state["done"] + take).alias("done"),
                F.concat(state["taken"], F.array(F.struct(node["home"].alias("home"), state["done"].alias("lo"), (state["done"] + take).alias("hi")))).alias("taken"),
            )
        )

    laps = F.concat(
        F.transform("nodes", lambda x: F.struct(x["home"].alias("home"), (x["n"] - x["keep"]).alias("over"))),
        F.transform("nodes", lambda x: F.struct(x["home"].alias("home"), F.lit(0).cast("long").alias("over"))),
    )
    walked = everything.select("nodes", F.aggregate(laps, start, step)["taken"].alias("taken"))
    own = walked.select(F.explode("nodes").alias("x")).select("x.node", F.col("x.home").alias("shard"), F.lit(0).cast("long").alias("lo"), F.col("x.keep").alias("hi"))
    # Overflowing rows are numbered around the ring; an interval of these numbers goes to one shard.
    moved = walked.select("taken", F.explode(F.filter("nodes", lambda x: x["n"] > x["keep"])).alias("x")).select(
        "x", F.explode(F.filter("taken", lambda t: (t["hi"] > F.col("x.over_from")) & (t["lo"] < F.col("x.over_from") + F.col("x.n") - F.col("x.keep")))).alias("t")
    )
    shift = F.col("x.keep") - F.col("x.over_from")
    moved = moved.select(
        "x.node", F.col("t.home").alias("shard"), F.greatest(F.col("t.lo") + shift, F.col("x.keep")).alias("lo"), F.least(F.col("t.hi") + shift, F.col("x.n")).alias("hi")
    )
    segments = own.unionByName(moved).where("hi > lo")
    size = F.col("hi") - F.col("lo")
    slot = F.sum(size).over(Window.partitionBy("shard").orderBy("node", "lo")) - size
    return segments.withColumn("slot", slot).groupBy("node").agg(F.collect_list(F.struct("shard", "lo", "hi", "slot")).alias("segments"))


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """df with columns shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Counts of shards are at most one apart. Rows are placed by the hash of `key`, a null key like any
    other value; rows of equal keys are neighbours on the ring. Rows equal in all columns are
    interchangeable. An empty table gives an empty table. Columns named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = without(df, "shard", "slot")
    cells = ring(spark, shards, virtual_nodes)
    hashed = F.xxhash64(F.lit("key"), F.col(key))
    placed = df.select(F.struct(*df.columns).alias("row"), hashed.alias("place")).withColumn("cell", F.pmod(F.shiftright("place", 20), F.lit(CELLS)).cast("int"))
    counts = df.select(F.pmod(F.shiftright(hashed, 20), F.lit(CELLS)).cast("int").alias("cell")).groupBy("cell").count()
    by_node = cells.join(counts, "cell", "left").groupBy("node", "home").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    plan = _walk(by_node, shards)
    # Both sides of these broadcasts are bounded by CELLS and shards * virtual_nodes.
    numbered = placed.join(F.broadcast(cells.select("cell", "node")), "cell").withColumn(
        "rank", F.row_number().over(Window.partitionBy("node").orderBy("place", *[F.col(f"row.{_quoted(c)}") for c in _sortable(df)])) - 1
    )
    placed = numbered.join(F.broadcast(plan), "node")
    segment = F.filter("segments", lambda s: (F.col("rank") >= s["lo"]) & (F.col("rank") < s["hi"]))[0]
    return placed.withColumn("segment", segment).select(
        "row.*", F.col("segment.shard").alias("shard"), (F.col("segment.slot") + F.col("rank") - F.col("segment.lo")).cast("long").alias("slot")
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sortable(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards. Law `rows`: counts of shards are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign_shards(slim, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
