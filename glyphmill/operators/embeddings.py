"""Vectors: hashed grams, nearest neighbours, anomaly, cohesion, late interaction, tree edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a

#: Queries held by one block of the neighbour search.
BLOCK = 256
#: Parts into which the rows are dealt.
PARTS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hashed_grams(df: DataFrame, dimensions: int = 128) -> DataFrame:
    """df(id, text) to (id, bucket, n): counts of character trigrams by FNV-1a bucket."""
    n = F.char_length("text")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("text", i, F.lit(3))))
    each = df.select("id", F.explode(grams).alias("g"))
    distinct = each.groupBy("id", "g").agg(F.count("*").alias("n"))
    # an unsigned remainder of the signed long; dimensions divides 2^64
    bucket = F.pmod(fnv1a(F.col("g").cast("binary")), F.lit(dimensions)).cast("int")
    return distinct.groupBy("id", bucket.alias("bucket")).agg(F.sum("n").cast("long").alias("n"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, own: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact: (query, id, similarity, rank) of the k most cosine-similar rows for each query, ties to the smaller id.

    Queries are dealt in blocks of bounded size; each partition of rows meets each block in one matrix product and
    passes on k rows a query only. own: whether a query may find itself.
    """
    blocks = queries.select("id", "v").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    parts = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("long").alias("part"))
    # the stated query set against all rows, in blocks: (blocks * parts) packed rows
    keyed = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, v = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
            norm = np.linalg.norm(v, axis=1)
            for packed_queries in right["queries"]:
                names = np.array([q["id"] for q in packed_queries])
                w = np.stack([np.asarray(q["v"], float) for q in packed_queries])
                scale = norm[None, :] * np.linalg.norm(w, axis=1)[:, None]
                scores = np.divide(w @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)
                for i, name in enumerate(names):
                    order = np.lexsort((ids, -scores[i]))
                    order = [j for j in order[: k + 1] if own or ids[j] != name]
                    out += [(name, ids[j], scores[i, j]) for j in order[:k]]
        return pd.DataFrame(out, columns=["query", "id", "similarity"]).astype({"query": "int64", "id": "int64", "similarity": "float64"})

    found = parts.groupBy("part").cogroup(keyed.groupBy("part")).applyInPandas(run, "query long, id long, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anomaly_scores(neighbours: DataFrame, top: int) -> DataFrame:
    """1 - the mean similarity of each query's neighbours; the `top` highest."""
    return neighbours.groupBy("query").agg((1 - F.avg("similarity")).alias("score")).orderBy(F.col("score").desc(), "query").limit(top)


def cohesion(rows: DataFrame) -> DataFrame:
    """rows(id, v, module): mean cosine of pairs inside each module less that of pairs across, for modules of two
    members or more where there are two modules.

    No pairs are made: the sum of all pairwise cosines is the squared length of the summed unit vectors.
    """
    unit = rows.select("module", F.posexplode(normalised(F.col("v"))).alias("i", "x"))
    by = unit.groupBy("module", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = by.groupBy("i").agg(F.sum("s").alias("t"))
    sums = by.join(total, "i").groupBy("module").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("t")).alias("st"), F.sum("q").alias("q"))
    sizes = rows.groupBy("module").agg(F.count("*").alias("members"))
    everything = sizes.agg(F.sum("members").alias("all"), F.count("*").alias("modules"))
    out = sums.join(sizes, "module").join(F.broadcast(everything)).where("members >= 2 and modules >= 2")
    inside = (F.col("ss") - F.col("q")) / (F.col("members") * (F.col("members") - 1))
    across = (F.col("st") - F.col("ss")) / (F.col("members") * (F.col("all") - F.col("members")))
    return out.select("module", "members", inside.alias("inside"), across.alias("across"), (inside - across).alias("cohesion"))


def least_cosines(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """Smallest pairwise cosine in each group; groups of one member are left out.

    Members are dealt in blocks of about `block`; each pair of a group's blocks meets in one matrix product and
    passes on one number.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.select(group, "id", "v").join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = dealt.groupBy(group, "block").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    other = packed.select(group, F.col("block").alias("other"), F.col("m").alias("n"))

    @F.pandas_udf("double")
    def least(ids: pd.Series, vs: pd.Series, names: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for left, v, right, w in zip(ids, vs, names, ws, strict=True):
            v, w = ([np.asarray([] if x is None else x, float) for x in side] for side in (v, w))
            scores = np.zeros((len(v), len(w)))
            for size in {len(x) for x in v} & {len(x) for x in w} - {0}:
                i, j = ([k for k, x in enumerate(side) if len(x) == size] for side in (v, w))
                a, b = np.stack([v[k] for k in i]), np.stack([w[k] for k in j])
                scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                scores[np.ix_(i, j)] = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale != 0)
            pairs = scores[np.asarray(left)[:, None] != np.asarray(right)[None, :]]
            out.append(np.fmin.reduce(pairs) if len(pairs) else None)
        return pd.Series(out, dtype="float64")

    both = packed.join(other, group).where("block <= other").select(group, least("m.id", "m.v", "n.id", "n.v").alias("least"))
    return both.where("least is not null").groupBy(group).agg(F.min("least").alias("least"))


def max_sim(a: Column, b: Column) -> Column:
    """Late interaction of two token matrices: mean of the two directions' mean best dot products."""
    best = lambda x, y: F.transform(x, lambda v: F.array_max(F.transform(y, lambda w: dot(v, w))))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (mean(best(a, b)) + mean(best(b, a))) / 2).otherwise(F.lit(0.0))


def tree_distance(a: dict, b: dict) -> int:
    """Edit distance of ordered trees (insert, delete, rename cost 1), by key roots. A tree has post-order arrays
    labels and left_leaf (index of each node's leftmost leaf)."""

    def key_roots(t: dict) -> list[int]:
        return sorted({leaf: i for i, leaf in enumerate(t["left_leaf"])}.values())

    n, m = len(a["labels"]), len(b["labels"])
    if not n or not m:
        return n + m
    la, lb = a["left_leaf"], b["left_leaf"]
    whole = np.zeros((n, m), int)
    for i in key_roots(a):
        for j in key_roots(b):
            part = np.zeros((i - la[i] + 2, j - lb[j] + 2), int)
            part[:, 0], part[0, :] = np.arange(part.shape[0]), np.arange(part.shape[1])
            for x in range(1, part.shape[0]):
                for y in range(1, part.shape[1]):
                    p, q = la[i] + x - 1, lb[j] + y - 1
                    edge = min(part[x - 1, y], part[x, y - 1]) + 1
                    if la[p] == la[i] and lb[q] == lb[j]:
                        part[x, y] = min(edge, part[x - 1, y - 1] + (a["labels"][p] != b["labels"][q]))
                        whole[p, q] = part[x, y]
                    else:
                        part[x, y] = min(edge, part[la[p] - la[i], lb[q] - lb[j]] + whole[p, q])
    return int(whole[n - 1, m - 1])


def tree_similarity(a: Column, b: Column) -> Column:
    """1 - distance / larger size of two trees (labels, left_leaf); 1 for two empty ones."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        out = []
        for la, fa, lb, fb in zip(x["labels"], x["left_leaf"], y["labels"], y["left_leaf"], strict=True):
            most = max(len(la), len(lb))
            out.append(1.0 - tree_distance({"labels": list(la), "left_leaf": list(fa)}, {"labels": list(lb), "left_leaf": list(fb)}) / most if most else 1.0)
        return pd.Series(out)

    return run(a, b)
