"""Exact top-k inner-product search: ball-tree branch and bound in each shard of the candidates.

Candidates are dealt to shards by hash. A task gets a shard's candidates first, builds their ball tree once, and then
streams the queries past it. For each query nodes are taken from a queue by falling upper bound q.c + |q| r: an inner
node puts its children in, a leaf is scored, and the search ends when the highest bound is below the query's current k-th
score. Shards are searched in rounds of one, one, two, four and so on; every round starts from the k-th scores of all
earlier ones. Scores are integers, so ties are exact; a node that could tie is visited.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table

#: Candidates of a shard on average, and queries whose bounds are computed at once.
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LEAF_ROWS = 64
SCALE = 1024
K = 10
_EXACT = float(1 << 52)


def to_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector or one of its components is null
    or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = vector.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


class BallTree:
    """Nodes are split at the median of the coordinate with the widest spread down to LEAF_ROWS rows; children follow
    their parent. Geometry is in doubles, with room for their rounding; scores are whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        rows = vectors.astype(np.float64)
        self.most = float(np.abs(rows).max(initial=0))
        self.vectors, self.rows = vectors, rows
        self.members: list[np.ndarray] = [np.arange(len(ids))]
        self.children: list[tuple[int, ...]] = []
        centres, radii = [], []
        while len(self.children) < len(self.members):
            own = self.members[len(self.children)]
            part = rows[own]
            centres.append(part.mean(axis=0) if part.shape[1] else np.zeros(0))
            radii.append(np.sqrt(((part - centres[-1]) ** 2).sum(axis=1).max()))
            spread = part.max(axis=0) - part.min(axis=0) if part.shape[1] else np.zeros(1)
            if len(own) <= LEAF_ROWS or not spread.max():
                self.children.append(())
                continue
            order = np.argsort(part[:, int(spread.argmax())], kind="stable")
            self.children.append((len(self.members), len(self.members) + 1))
            self.members += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.centres, self.radii = np.stack(centres), np.array(radii)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: list[int | None], k: int):
        """For each query its best rows as (score, -id) in falling order. floor: a score that k rows elsewhere
        reach (None: none known); rows below it may be left out."""
        wanted = queries.astype(np.float64)
        norms = np.sqrt((wanted**2).sum(axis=1))
        bounds = wanted @ self.centres.T + norms[:, None] * self.radii[None, :]
        # rounding may not hide a node
        bounds += 1e-9 * norms[:, None] * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii + 1)[None, :] + 1e-6
        whole = self.most * float(np.abs(wanted).max(initial=0)) * max(1, queries.shape[1]) < _EXACT  # doubles hold every sum
        for i in range(len(queries)):
            best: list[tuple[int, int]] = []
            least = -np.inf if floor[i] is None else floor[i]
            queue = [(-bounds[i, 0], 0)]
            while queue and -queue[0][0] >= least:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-bounds[i, child], child))
                    continue
                own = self.members[node]
                scores = self.rows[own] @ wanted[i] if whole else self._long(own, queries[i])
                near = scores >= least
                found = [(int(x), -y) for x, y in zip(scores[near].tolist(), self.ids[own[near]].tolist(), strict=True) if y != query_ids[i]]
                if found:
                    best = sorted(best + found, reverse=True)[:k]
                    if len(best) == k:
                        least = max(least, best[-1][0])
            yield best

    def _long(self, own: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores by Python's integers, where doubles would round; those beyond a long are set to the nearest long."""
        exact = (self.vectors[own].astype(object) * query.astype(object)).sum(axis=1) if len(query) else np.zeros(len(own), object)
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in exact], object)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _searched(k: int):
    """Rows (dim, shard, asked, vec_id, vector, least), those of a shard one after the other and its candidates (asked false)
    first, to (query_id, vec_id, score)."""

    def runs(batches):
        """Parts of the batches of one (dim, shard, asked)."""
        for batch in batches:
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("dim", "shard", "asked")], axis=1)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)

    def run(batches):
        at, held, tree = None, [], None
        for (dim, shard, asked), part in runs(batches):
            if at != (dim, shard):
                at, held, tree = (dim, shard), [], None
            ids, vectors = part.column("vec_id").to_numpy(), _matrix(part, dim)
            if not asked:
                held.append((ids, vectors))
                continue
            if tree is None and held:
                tree, held = BallTree(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            if tree is None:
                continue
            floor = part.column("least").to_pylist()
            for start in range(0, len(ids), BLOCK_QUERIES):
                block = slice(start, start + BLOCK_QUERIES)
                answers = tree.search(ids[block], vectors[block], floor[block], k)
                out = [(q, -negative, score) for q, best in zip(ids[block].tolist(), answers, strict=True) for score, negative in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """candidates, queries (vec_id, vector: array<long>) to (query_id, rank, vec_id, score): for each query the
    k highest inner products with candidates of another id (all, if fewer), ties to the smaller vec_id.

    Null ids or vectors take no part; only vectors of one length meet. Equal (vec_id, vector) rows count once; other columns
    are not read. Empty tables give an empty table. A task holds a shard of about SHARD_ROWS candidates and a
    batch of queries; every candidate is moved once. The shards' answers (k a query) are merged by a window.
    """
    prepare(candidates.sparkSession)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id is not null and vector is not null").withColumn("dim", F.size("vector"))
    rows = cut(clean(candidates).dropDuplicates(["vec_id", "vector"]))
    asked = cut(clean(queries).dropDuplicates(["vec_id", "vector"]).withColumn("least", F.lit(None).cast("long")))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "vec_id", "vector"), F.lit(shards)).cast("int"))
    columns = ["dim", "shard", "asked", "vec_id", "vector", "least"]

    def searched(asked: DataFrame, first: int, stop: int) -> DataFrame:
        # each query meets each shard: the stated query set against all rows
        own = rows.where((F.col("shard") >= first) & (F.col("shard") < stop)).select("dim", "shard", F.lit(0).alias("asked"), "vec_id", "vector", F.lit(None).cast("long").alias("least"))
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(stop - 1)))).withColumn("asked", F.lit(1))
        dealt = own.unionByName(sent.select(*columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asked", "vec_id")
        return dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found, done = cut(best(searched(asked, 0, 1))), 1
    while done < shards:
        least = found.groupBy("query_id").agg(F.min("score").alias("known"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "known")
        started = asked.join(least, F.col("vec_id") == F.col("query_id"), "left").select("dim", "vec_id", "vector", F.col("known").alias("least"))
        stop = min(shards, 2 * done)
        found = cut(best(found.drop("rank").unionByName(searched(started, done, stop))))
        done = stop
    return found.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", to_integers(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))
