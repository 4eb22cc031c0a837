"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1 (piecewise linear). Its integral gives the
source's share of all tokens; its running integral, inverted, tells at which time the source's cumulative
token demand reaches a document, and that time is the document's position. Sorting by position (range
partitioned) gives the training order.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, without

#: The schedules of sources by code point order, repeating: weight at time 0 and weight at time 1.
SCHEDULES = ((7.0, 3.0), (2.0, 2.0), (0.5, 1.5))
SHARE = (3, 2)  # 150 % of all sizes
MOST_REPEATS = 2
#: Rows of a source in one part of its stream; parts are chosen by hash.
PART_ROWS = 2000
#: Sources or parts up to which their sums are broadcast.
MOST_BROADCAST = 200_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def integrals(schedules=SCHEDULES) -> tuple[int, ...]:
    """The schedules' integrals over time, all times the least number that makes them integers."""
    exact = [(Fraction(a) + Fraction(b)) / 2 for a, b in schedules]
    scale = lcm(*[x.denominator for x in exact])
    return tuple(int(x * scale) for x in exact)


def targets(sizes: DataFrame, schedules=SCHEDULES, share: tuple[int, int] = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """sizes(source, source_size, n) to the same with weight_class and target: share of all sizes by weight (the
    integral of the source's schedule), at most `most` times the own size, the excess reshared by weight until none is above.

    Sources whose target is capped are the first ones by most * size / weight, so one ordered pass finds them.
    All windows run over one row a source.
    """
    weights = integrals(schedules)
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight_class = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("weight_class") + 1).cast("long")
    ranked = sizes.withColumn("weight_class", weight_class).withColumn("weight", weight)
    need = F.col("source_size") * most
    # size / weight as exact integers over the weights' product
    product = 1
    for w in weights:
        product *= w
    order = Window.orderBy(F.col("source_size") * (F.lit(product) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * share[0] - F.coalesce(F.sum(need * share[1]).over(earlier), F.lit(0))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    stepped = ranked.withColumn("rest", rest).withColumn("weights_left", weights_left)
    capped = stepped.withColumn("capped", F.col("weight") * F.col("rest") >= need * share[1] * F.col("weights_left"))
    # The first source that isn't capped has the level for itself and all later ones.
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") * (F.lit(product) / F.col("weight")).cast("long")), F.col("source").isNull(), "source", "rest", "weights_left"))).over(everything)
    level = capped.withColumn("first", first)
    target = F.when(F.col("capped"), need.cast("double")).otherwise(
        (F.col("weight") * F.col("first.rest")).cast("double") / (F.col("first.weights_left") * share[1]).cast("double")
    )
    return level.select("source", "source_size", "n", "weight_class", target.alias("target"))


def position(offset: Column, target: Column, weight_class: Column, schedules=SCHEDULES) -> Column:
    """Time at which the running integral of the source's schedule, scaled to its target, reaches the offset."""
    a = F.element_at(F.array(*[F.lit(x) for x, _ in schedules]), weight_class + 1)
    b = F.element_at(F.array(*[F.lit(x) for _, x in schedules]), weight_class + 1)
    part = F.when(target > 0, F.least(F.lit(1.0), offset / target)).otherwise(F.lit(0.0)) * (a + b) / 2
    # (b - a) / 2 t^2 + a t = part; stable also where a = b
    return F.when(part <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * part / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * part)))))


def _small(df: DataFrame) -> DataFrame:
    """df, written; marked for broadcast if it has at most MOST_BROADCAST (short) rows, else joined by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def mix(df: DataFrame, size: Column | None = None, schedules=SCHEDULES, share=SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """df(doc_id, source, text, ...) with size, source_size, target, repeats (0 to `most`), taken (repeats * size)
    and positions (one time a repeat, ascending).

    Each source is one stream: its documents by md5 of doc_id, then the same again; the stream is cut at the
    source's target, a document being in when its middle is. So taken words differ from the target by half a
    document at most, reruns agree, and no document comes more than `most` times. A source that gets its cap
    comes whole. Documents of size 0 follow their place. Null sources are one source; null ids hash as empty.
    Rows equal in id, size and all other columns are interchangeable. Empty table: empty table.

    Offsets are prefix sums in two levels: within parts of about PART_ROWS rows of a source, and over the
    parts' sums, so a source with a third of all rows is many parts.
    """
    df = without(df, "size", "source_size", "target", "repeats", "taken", "positions")
    size = word_count(F.col("text")) if size is None else size
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    rows = df.select(F.struct(*df.columns).alias("row"), F.col("source").alias("source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"), size.alias("size"), tie.alias("tie"))
    sized = df.select(F.col("source").alias("source"), size.alias("size"))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), schedules, share, most)
    known = rows.join(_small(aims.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART_ROWS))
    part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * parts).cast("long")
    known = known.withColumn("part", part)
    sums = known.select("source", "part", "size").groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.withColumn("start", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    sums = sums.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "start")
    sums = _small(sums)
    within = Window.partitionBy("source", "part").orderBy("place", "size", "tie")
    numbered = known.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = numbered.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    offset = F.col("start") + F.col("inner")
    offsets = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: offset + i * F.col("source_size"))
    taken = F.filter(offsets, lambda x: x + F.col("size") / 2.0 <= F.col("target"))
    return placed.withColumn("offsets", taken).select(
        "row.*", "size", "source_size", "target", F.size("offsets").cast("int").alias("repeats"), (F.size("offsets") * F.col("size")).cast("long").alias("taken"),
        F.transform("offsets", lambda x: position(x.cast("double"), F.col("target"), F.col("weight_class"), schedules)).alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for every time a document is taken, with its position, sorted by position over the whole table."""
    rest = [c for c in mixed.columns if c != "positions"]
    return mixed.select(*rest, F.explode("positions").alias("position")).orderBy("position", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document, sorted by its first position over the whole table; documents not taken come last."""
    docs = table(spark, sf_dir, "documents")
    # Written once: the sums, the parts' sums and the places all need the sizes, and texts are long.
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    mixed = mix(slim, size=F.col("words"))
    ordered = mixed.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")
