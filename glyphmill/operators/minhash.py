"""MinHash pipeline: blocks, shingles, signatures, bands, candidates, verification, groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from .graph import components

#: Fixed value: the Mersenne prime by which signatures are folded.
MERSENNE = (1 << 61) - 1
_MASK = (1 << 64) - 1
#: Queries up to which their signatures are broadcast.
MOST_BROADCAST = 20_000


def split_mix(seed: int):
    """64-bit numbers of the SplitMix generator."""
    state = seed & _MASK
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        yield z ^ (z >> 31)


def coefficients(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """n pairs a (not 0), b below the Mersenne prime."""
    draw = split_mix(seed)
    a = [1 + next(draw) % (MERSENNE - 1) for _ in range(n)]
    b = [next(draw) % MERSENNE for _ in range(n)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def folded(x: np.ndarray) -> np.ndarray:
    """One fold of 64-bit numbers into the Mersenne prime's range."""
    m = np.uint64(MERSENNE)
    y = (x & m) + (x >> np.uint64(61))
    return np.where(y >= m, y - m, y)


def _minima(x: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if x is None or not len(x):
        return np.full(len(a), -1, np.int64)
    x = np.asarray(x, np.int64).view(np.uint64)
    best = np.full(len(a), _MASK, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(best, folded(a[:, None] * x[None, i : i + 512] + b[:, None]).min(axis=1), out=best)
    return best.view(np.int64)


def signature(hashes: Column, n: int = 256, seed: int = 42) -> Column:
    """Array of n minima of fold(a x + b mod 2^64) over the hashes; of no hashes all ones (-1)."""
    a, b = coefficients(n, seed)

    @F.pandas_udf("array<bigint>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([_minima(x, a, b) for x in column])

    return run(hashes)


def signed_sets(docs: DataFrame, n: int = 256, seed: int = 42) -> DataFrame:
    """docs(id, hashes) to (id, digest, sig): the set's digest, equal for equal sets, and its signature, in one pass."""
    a, b = coefficients(n, seed)

    def run(column: pd.Series) -> pd.DataFrame:
        sets = [np.sort(np.asarray(x if x is not None else [], np.int64)) for x in column]
        return pd.DataFrame({"digest": [hashlib.sha256(x.tobytes()).digest() for x in sets], "sig": [_minima(x, a, b) for x in sets]})

    # annotations as objects, which the kind of function is told by
    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return docs.select("id", F.pandas_udf(run, "digest binary, sig array<bigint>")("hashes").alias("s")).select("id", "s.*")


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for signatures of different lengths or none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def sequence_similarity(a: Column, b: Column, exact: bool = True, n: int = 256) -> Column:
    """Jaccard similarity of two sequences' shingle hashes; estimated by n minima of each if not exact."""
    return jaccard(a, b) if exact else signature_similarity(signature(a, n), signature(b, n))


def weighted_hashes(entries: Column, most: int = 10) -> Column:
    """(hash, count) entries as hashes with multiplicity: hash + i * 2654435761 for i below min(count, most).
    The hashes must leave room for the addition."""
    return F.flatten(F.transform(entries, lambda e: F.transform(F.sequence(F.lit(0), F.least(e["count"], F.lit(most)).cast("int") - 1), lambda i: e["hash"] + i * F.lit(2654435761))))


def bands_and_rows(n: int, threshold: float) -> tuple[int, int]:
    """Bands b and rows n // b whose threshold (1 / b) ^ (1 / rows) is nearest the given one; the first best."""
    best = min(range(1, n + 1), key=lambda b: abs((1 / b) ** (1 / (n // b)) - threshold))
    return best, n // best


def blocks(tokens: Column, size: int) -> Column:
    """(start, tokens) of windows of `size` tokens at half-size strides; a last, partial window is left out."""
    stride = max(1, size // 2)
    starts = F.sequence(F.lit(0), F.size(tokens) - size, F.lit(stride))
    return F.when(F.size(tokens) >= size, F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(tokens, i + 1, size).alias("tokens")))).otherwise(F.array().cast("array<struct<start:int,tokens:array<string>>>"))


def candidates(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """signatures(id, sig) to (id1, id2), id1 < id2: equal in all rows of one band or more.

    The band's slice itself is the key. Copies should have been reduced to one id (see set_classes()), so that a
    bucket holds different texts only.
    """
    usable = signatures.where(F.size("sig") >= bands * rows)
    keyed = usable.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.slice("sig", b * rows + 1, rows))).alias("band", "key"))
    other = keyed.select(F.col("id").alias("id2"), "band", "key")
    return keyed.join(other, ["band", "key"]).where("id < id2").select(F.col("id").alias("id1"), "id2").distinct()


def set_classes(docs: DataFrame) -> DataFrame:
    """docs(id, hashes) to (id, rep): rep is the smallest id with an equal set."""
    keyed = docs.select("id", F.sha2(F.array_join(F.sort_array("hashes"), ",").cast("binary"), 256).alias("digest"))
    return keyed.join(keyed.groupBy("digest").agg(F.min("id").alias("rep")), "digest").select("id", "rep")


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with the exact Jaccard of their hash sets, from the threshold on; pairs of overlapping line ranges of
    one file are left out. docs: id, hashes and, optionally, file, start_line, end_line."""
    placed = {"file", "start_line", "end_line"} <= set(docs.columns)
    columns = ["hashes", *(["file", "start_line", "end_line"] if placed else [])]
    side = lambda n: docs.select(F.col("id").alias(f"id{n}"), *[F.col(c).alias(f"{c}{n}") for c in columns])
    both = pairs.join(side(1), "id1").join(side(2), "id2").withColumn("similarity", jaccard(F.col("hashes1"), F.col("hashes2")))
    if placed:
        both = both.where(~((F.col("file1") == F.col("file2")) & (F.col("start_line1") <= F.col("end_line2")) & (F.col("start_line2") <= F.col("end_line1"))))
    return both.where(F.col("similarity") >= threshold).select("id1", "id2", "similarity")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of verified pairs: members, mean similarity of their pairs, sorted ids as fingerprint."""
    found = components(pairs.select(F.col("id1").alias("u"), F.col("id2").alias("v")))
    similarity = pairs.join(found, pairs["id1"] == found["node"]).groupBy("component").agg(F.avg("similarity").alias("similarity"))
    members = found.groupBy("component").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_set("node")), "-").alias("fingerprint"))
    return members.join(similarity, "component").select("component", "members", "similarity", "fingerprint")


def similar_to(signatures: DataFrame, wanted: DataFrame, bands: int, rows: int, threshold: float, probes: int = 0) -> DataFrame:
    """signatures, wanted (id, sig) to (query, id, similarity): rows that share a band with a query, by signature
    similarity from the threshold on. probes: further keys of each band, made by leaving out one row each, so that a
    band that differs in that row only is still met."""

    def keys(df: DataFrame) -> DataFrame:
        whole = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.lit(-1).alias("without"), F.slice("sig", b * rows + 1, rows).alias("key")))
        out = [whole]
        for r in range(min(probes, rows)):
            left_out = lambda b, r=r: F.concat(F.slice("sig", b * rows + 1, F.lit(r)), F.slice("sig", b * rows + 2 + r, F.lit(rows - r - 1)))
            out.append(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b, f=left_out, r=r: F.struct(b.alias("band"), F.lit(r).alias("without"), f(b).alias("key"))))
        return df.select("id", F.explode(F.concat(*out)).alias("k")).select("id", "k.*")

    # the pairs meet without their signatures, of which each id has but one
    mine = keys(wanted).withColumnRenamed("id", "query")
    met = keys(signatures).join(mine, ["band", "without", "key"]).where("id <> query").select("query", "id").distinct()
    asked = wanted.select(F.col("id").alias("query"), F.col("sig").alias("wanted"))
    asked = F.broadcast(asked) if wanted.count() <= MOST_BROADCAST else asked
    both = met.join(signatures.select("id", "sig"), "id").join(asked, "query")
    return both.select("query", "id", signature_similarity(F.col("sig"), F.col("wanted")).alias("similarity")).where(F.col("similarity") >= threshold)
