"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's word shingles. Sketches of parts merge to the sketch
of their union, and two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shingle_hashes, table, word_hashes

K = 128
WORDS = 5
#: Characters that one step of the sketching task holds.
STEP_CHARS = 4 << 20
#: Rows of the table in one range of ids, and ranges at most (their bounds go to the driver).
BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 16


def sketches(texts: list[str | None], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Bottom-k sketch of each text; a text without words has an empty one."""
    if not texts:
        return []
    return [s[:k].copy() for s in shingle_hashes(*word_hashes(texts), words)]


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what the parts are sketches of."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection / union; exact while the union has at most k shingles. Two empty sketches: 1."""
    union = merge(a, b, k=k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has. An empty a: 1."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k=k), k) / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third of the text (rounded down) replaced by as many first characters of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _steps(batches):
    """Rows of the batches in lists of about STEP_CHARS characters; the last row of a list begins the next."""
    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("pid", "guest", "doc_id", "text")), strict=True):
            held.append(row)
            chars += len(row[3])
            if chars >= STEP_CHARS and len(held) > 1:
                yield held
                held, chars = held[-1:], len(held[-1][3])
    if held:
        yield held


def _compared(k: int, words: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "held_by_edited", "held_by_next"]

    def run(batches):
        for rows in _steps(batches):
            own = sketches([r[3] for r in rows], k, words)
            pairs = [(i, edited(rows[i][3], rows[i + 1][3])) for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            other = sketches([t for _, t in pairs], k, words)
            out = [
                (
                    rows[i][2], len(rows[i][3]), hashlib.sha256(t.encode()).hexdigest(), encode(own[i]), encode(e),
                    resemblance(own[i], e, k), resemblance(own[i], own[i + 1], k), distinct(own[i], k), containment(own[i], e, k), containment(own[i], own[i + 1], k),
                )
                for (i, t), e in zip(pairs, other, strict=True)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return run


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text): fingerprints of every whole text and of its edited text, see edited(); the estimated likeness of
    the text to the edited and to the next one, its number of distinct shingles, and the share of them that the
    edited and the next one hold.

    The next document is the next row by descending doc_id (null ids last; rows of one id by text), after the
    last one the first; of a single row it is the row itself. Null texts are empty. A row in, a row out.

    The texts are dealt once, by ranges of doc_id: each bucket also gets the first row of the next one as a
    guest, and a task walks its rows in order. Ranges come from a quantile summary of the ids.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.count()
    buckets = min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    if len(cuts) > 1:
        ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range", handleInvalid="keep")
        placed = ranges.transform(docs.withColumn("at", F.col("doc_id").cast("double")))
        # Bucket 0 has the largest ids, null ids come after all others.
        placed = placed.select("doc_id", "text", F.when(F.col("at").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("range")).cast("int").alias("pid"))
    else:
        placed = docs.withColumn("pid", F.lit(0))
    heads = placed.groupBy("pid").agg(F.max("doc_id").alias("head")).orderBy("pid").collect()  # a row a bucket
    following = [(to["pid"], of["pid"], of["head"]) for to, of in zip(heads, [*heads[1:], *heads[:1]], strict=True)]
    # The first row of each bucket also goes, as a guest, to the bucket before it.
    guests = placed.join(
        F.broadcast(docs.sparkSession.createDataFrame(following, "to int, of int, head long")), (F.col("pid") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head"))
    ).select("doc_id", "text", F.col("to").alias("pid"), F.lit(True).alias("guest"))
    everyone = placed.select("doc_id", "text", "pid", F.lit(False).alias("guest")).unionByName(guests)
    dealt = everyone.repartitionById(len(cuts) + 2, F.col("pid")).sortWithinPartitions("pid", "guest", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_by_edited double, held_by_next double"
    return dealt.select("pid", "guest", "doc_id", "text").mapInArrow(_compared(k, words), schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
