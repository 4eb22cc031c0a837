"""Shared helpers: table access, lineage cuts in the shared checkpoint folder, word hashing."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from glyphmill.operators.checkpoints import folder

_CHECKPOINT = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends, read when a DataFrame is made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in one Arrow batch handed to Python, so that a batch of long texts stays small.
_BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder from the session's setting (an own one only where unset on one machine), small Arrow batches."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(sc.master, spark.conf.get(_CHECKPOINT, None)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there. The files of its shuffles, which nothing
    reads again, go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    prepare(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names clash (in any case) with those that an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """df's schema and further columns of these types."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()]])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_known = _Hashes()
_MOST_KNOWN = 1 << 19


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ of texts (A-Z lower-cased; null: empty) and offsets:
    text i has the words offsets[i]:offsets[i + 1]."""
    # lower() and split() of bytes know ASCII's letters and white space only
    words = [(t or "").encode().lower().split() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
    if len(_known) > _MOST_KNOWN:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, chain.from_iterable(words)), np.uint64, int(offsets[-1])), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; with fewer words the
    whole sequence is one shingle; without words the set is empty."""
    n = len(words)
    seeded = words ^ np.uint64(0x9E3779B97F4A7C15)
    rolled = np.empty(0, np.uint64)
    if n >= k:
        rolled = mix64(seeded[: n - k + 1])
        for j in range(1, k):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + seeded[j : n - k + 1 + j])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = mix64(seeded[a : a + 1])
            for j in range(a + 1, b):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + seeded[j : j + 1])
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Parts of batch that hold about most_bytes of the text column each (one row at least)."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
