"""Near-duplicate documents: universal hash minima, banding, signature check, full-set check, components.

1. Every text becomes its set of k-word shingle hashes; the set gives HASHES universal minima (a x + b),
   a key a band and one bit a minimum. Only ids, keys and bits leave the text's task.
2. Documents with equal sets form a class (grouped by a 128-bit digest, pre-aggregated); only the smallest
   id of a class goes on, so thousands of copies are one node.
3. Round one compares the members of a band bucket with its smallest member only: one pair a member.
   Pairs whose bits rule out the threshold are dropped, the others are confirmed on full shingle sets, and
   the links joined to components.
4. Round two takes the buckets that still hold several components. All buckets with one largest component meet
   as one group, so documents that share many bands are dealt once. The group's documents outside that
   component are compared with all of the group in a grid of cells of CELL_SHINGLES shingles a side, by counting
   common shingles in an inverted index of the cell; only links that join components leave a cell. After it
   every two documents that share a bucket are in one component or compared, and no pairs were emitted.

A band has as many rows as a pair at the threshold allows to miss all bands with probability MISSED at most; the bit
check lets seven standard deviations pass.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, prepare, shingle_hashes, slices, table, word_hashes
from .components import connected_components

#: Minima of a signature; WORDS_OF_BITS longs hold a bit of each.
HASHES = 192
WORDS_OF_BITS = HASHES // 64
#: Probability at most that a pair at the threshold shares no band.
MISSED = 1e-5
#: Shingles of each side of a cell of round two, on average.
CELL_SHINGLES = 1 << 17
#: Postings that a cell's index looks at in one step.
STEP_POSTINGS = 1 << 22
#: Pairs that one copy of a hub's text serves.
PAIRS_A_HUB = 128
#: Ids up to which they are broadcast to the texts, 4 MB.
MOST_BROADCAST = 500_000

_seeds = np.random.Generator(np.random.PCG64(20240607))
_A = (_seeds.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND_SEED = _seeds.integers(0, 1 << 62, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of the multiply-add hashes of the shingles' upper halves; the set may not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(axis=1), out=out)
    return out


def rows_of_bands(threshold: float) -> int:
    """The most rows of a band with which a pair at the threshold misses all HASHES // rows bands with probability
    MISSED at most; ValueError where one row isn't enough."""
    fit = [r for r in range(1, 17) if 0 < threshold <= 1 and (1 - threshold**r) ** (HASHES // r) <= MISSED]
    if not fit:
        raise ValueError(f"{HASHES} minima can't find pairs at a similarity of {threshold}")
    return max(fit)


def most_bits(threshold: float) -> int:
    """Bits in which a pair at the threshold may differ: the mean and seven standard deviations."""
    p = (1 - threshold) / 2
    return int(HASHES * p + 7 * (HASHES * p * (1 - p)) ** 0.5)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """For each signature a 64-bit key a band."""
    bands = HASHES // rows
    keys = np.broadcast_to(_BAND_SEED[:bands], (len(signatures), bands)).copy()
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def bits(signatures: np.ndarray) -> np.ndarray:
    """One bit a minimum, packed in WORDS_OF_BITS longs."""
    odd = (mix64(signatures.astype(np.uint64)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(odd, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def _signed(k: int, rows: int):
    names = ["doc_id", "n_shingles", "digest", "keys", "bits"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(*word_hashes(part.column("text").to_pylist()), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                signatures = np.stack([minima(sets[i]) for i in full]) if len(full) else np.empty((0, HASHES), np.uint32)
                digests: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                for i, key, mark in zip(full.tolist(), band_keys(signatures, rows), bits(signatures), strict=True):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    keys[i], marks[i] = key, mark
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, long_list), pa.array(marks, long_list)], names=names
                )

    return run


def _confirmed(num: int, den: int, k: int):
    """Rows (hub, salt, member, text), the hub's own text first (member null): links of similarity num / den or more."""

    def run(batches):
        known: dict[int, list[np.ndarray]] = {}
        compared = False
        for batch in batches:
            hubs, members = [], []
            for part in slices(batch, "text"):
                sets = shingle_hashes(*word_hashes(part.column("text").to_pylist()), k)
                for hub, member, own in zip(part.column("hub").to_pylist(), part.column("member").to_pylist(), sets, strict=True):
                    if member is None:
                        if compared:
                            known.clear()
                            compared = False
                        known.setdefault(hub, []).append(own)
                        continue
                    compared = True
                    for other in known.get(hub, ()):
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if den * both >= num * (len(own) + len(other) - both):
                            hubs.append(hub)
                            members.append(member)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(members, pa.int64())], names=["u", "v"])

    return run


def _sets(k: int):
    """Rows (doc_id, text) to (doc_id, shingles): the set's hashes as bytes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_hashes(*word_hashes(part.column("text").to_pylist()), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


class _Cell:
    """One side of a cell as an inverted index: the documents outside the main component."""

    def __init__(self, ids: list[int], components: list[int], sets: list[np.ndarray]):
        self.ids, self.components = ids, components
        self.sizes = np.array([len(x) for x in sets], np.int64)
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.ends = np.append(first, len(hashes))
        self.roots: dict[int, int] = {}

    def _root(self, x: int) -> int:
        while (y := self.roots.get(x, x)) != x:
            x = y
        return x

    def joins(self, doc: int, component: int, own: np.ndarray, num: int, den: int):
        """(id, doc) of the links that join two components which the cell hasn't joined yet."""
        at = np.searchsorted(self.hashes, own)
        at = at[at < len(self.hashes)]
        at = at[self.hashes[at] == own[: len(at)]]
        first, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        both = np.zeros(len(self.ids), np.int64)
        steps = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), STEP_POSTINGS), "left").tolist()
        for a, b in zip(steps, [*steps[1:], len(size)], strict=True):
            n = size[a:b]
            flat = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both += np.bincount(self.owner[flat], minlength=len(both))
        for i in np.flatnonzero(den * both >= num * (self.sizes + len(own) - both)).tolist():
            a, b = self._root(self.components[i]), self._root(component)
            if a != b:
                self.roots[max(a, b)] = min(a, b)
                yield self.ids[i], doc


def _joins(num: int, den: int):
    """Rows (main, i, j, other, doc_id, component, shingles), a cell (main, i, j) after the other and those of its documents
    outside the main component (other 0) first: links between components."""

    def run(batches):
        at, few, cell = None, ([], [], []), None
        for part in (x for batch in batches for x in slices(batch, "shingles")):
            us, vs = [], []
            for row in zip(*[part.column(c).to_pylist() for c in part.schema.names], strict=True):
                main, i, j, other, doc, component, shingles = row
                if at != (main, i, j):
                    at, few, cell = (main, i, j), ([], [], []), None
                own = np.frombuffer(shingles, np.uint64)
                if not other:
                    for side, x in zip(few, (doc, component, own), strict=True):
                        side.append(x)
                    continue
                if not few[0]:
                    continue
                cell = cell or _Cell(*few)
                for u, v in cell.joins(doc, component, own, num, den):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _alike(a: str, b: str, most: int):
    differ = sum((F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(1, WORDS_OF_BITS)), F.bit_count(F.get(F.col(a), 0).bitwiseXOR(F.get(F.col(b), 0))))
    return differ <= most


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among the ids; few ids are broadcast, so that other texts aren't shuffled."""
    ids = cut(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """pairs(hub, member): the links (u, v) among them, by full shingle sets. Each member's text meets a copy
    of the hub's; a hub with many pairs is dealt in salted parts."""
    busy = cut(pairs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_A_HUB))
    salt = F.pmod(F.xxhash64("member"), F.coalesce(F.ceil(F.col("n") / PAIRS_A_HUB), F.lit(1)))
    pairs = cut(pairs.join(busy, "hub", "left").select("hub", "member", salt.alias("salt")))
    wanted = pairs.select(F.col("member").alias("doc_id"), "hub", "salt", "member").unionByName(
        pairs.select("hub", "salt").distinct().select(F.col("hub").alias("doc_id"), "hub", "salt", F.lit(None).cast("long").alias("member"))
    )
    texts = _of(docs, wanted.select("doc_id")).join(wanted, "doc_id").select("hub", "salt", "member", "text")
    dealt = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return dealt.mapInArrow(_confirmed(threshold.numerator, threshold.denominator, k), "u long, v long").distinct()


def _between(left: DataFrame, docs: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """left(main, doc_id, component, n): groups of documents that share a bucket with the component main. The links
    (u, v) that join components within a group, a forest a cell; n is a document's number of shingles."""
    few = F.col("component") != F.col("main")
    sides = left.groupBy("main").agg(F.sum("n").alias("all"), F.sum(F.when(few, F.col("n"))).alias("few"))
    # only groups of more than a cell have a row here
    sides = cut(sides.select("main", F.ceil(F.col("few") / CELL_SHINGLES).alias("rows"), F.ceil(F.col("all") / CELL_SHINGLES).alias("columns")).where("columns > 1"))
    dealt = left.join(sides, "main", "left").select("main", "doc_id", "component", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("columns", F.lit(1)).alias("columns"))
    of = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.col(n))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = dealt.where(few).select("main", of("rows", "i").alias("i"), to("columns").alias("j"), F.lit(0).alias("other"), "doc_id", "component")
    two = dealt.select("main", to("rows").alias("i"), of("columns", "j").alias("j"), F.lit(1).alias("other"), "doc_id", "component")
    sets = cut(_of(docs, left.select("doc_id")).mapInArrow(_sets(k), "doc_id long, shingles binary"))
    cells = one.unionByName(two).join(sets, "doc_id").select("main", "i", "j", "other", "doc_id", "component", "shingles")
    cells = cells.repartition("main", "i", "j").sortWithinPartitions("main", "i", "j", "other", "doc_id")
    return cells.mapInArrow(_joins(threshold.numerator, threshold.denominator), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), a row each.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Documents link when intersection / union of their sets
    of distinct k-word shingles (the whole sequence as one, with fewer words) is `threshold` or more;
    component_id is the smallest doc_id reachable and kept says doc_id = component_id. Null or empty texts
    have no shingles and no links. Rows that repeat a doc_id are one document, which any of their texts links,
    and come back each; a null doc_id is linked with nothing, its component_id is null and it is kept. Other columns
    are not read. An empty table gives an empty one. ValueError for a threshold that HASHES minima can't serve.
    """
    prepare(docs.sparkSession)
    rows, most = rows_of_bands(float(threshold)), most_bits(float(threshold))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_signed(k, rows), "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>"))
    nodes = signed.where("doc_id is not null and digest is not null")
    # Classes of equal sets; a row a class that has two members or more.
    classes = cut(nodes.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep"))
    in_class = nodes.join(classes, "digest", "left")
    reps = cut(in_class.where(F.coalesce("rep", "doc_id") == F.col("doc_id")).select("doc_id", "digest", "n_shingles", "keys", "bits").dropDuplicates(["doc_id", "digest"]))
    copies = in_class.where(F.col("rep") < F.col("doc_id")).select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))

    spread = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    members = cut(spread.join(cut(shared), "key").distinct())
    marks = reps.select("doc_id", "bits")
    first = members.where("doc_id <> hub").select("hub", F.col("doc_id").alias("member")).distinct()
    first = (
        first.join(marks.select(F.col("doc_id").alias("member"), F.col("bits").alias("a")), "member")
        .join(marks.select(F.col("doc_id").alias("hub"), F.col("bits").alias("b")), "hub")
        .where(_alike("a", "b", most)).select("hub", "member").distinct()
    )
    links = cut(_verify(cut(first), docs, threshold, k))
    found = cut(connected_components(links))

    # Round two: buckets that hold several components.
    at = cut(members.join(found, members["doc_id"] == found["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    counts = at.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    sizes = reps.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    left = cut(at.join(cut(mixed), "key").select("main", "doc_id", "component").distinct().join(sizes, "doc_id"))
    more = cut(_between(left, docs, threshold, k))

    joined = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(copies))
    out = signed.select("doc_id", "n_shingles").join(cut(joined), F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """docs with one row of each component of near-duplicates: that of the smallest doc_id (any one of its
    rows, where a doc_id repeats). Rows of a null doc_id stay."""
    marked = near_duplicates(docs, k, threshold)
    ids = marked.where("doc_id is not null").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    odd = cut(ids.where("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")))
    # only ids whose rows go or repeat; by broadcast if they are few
    side = F.broadcast(odd) if odd.count() <= MOST_BROADCAST else odd
    joined = docs.join(side, F.col("doc_id").cast("long") == F.col("__id"), "left")
    kept = joined.where("__id is null").select(*docs.columns)
    again = odd.where("__kept")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, F.col("doc_id").cast("long") == F.col("__id")).select(*docs.columns).dropDuplicates(["doc_id"]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, threshold=Fraction(85, 100))
