"""Repeated token windows of a corpus, found without moving each window.

Texts are dealt into chunks by their key. A window is looked for by its least part: of the runs of PART of its tokens
the one of the least hash (the first of these), which windows side by side mostly share and equal windows always do. A
chunk tells 40-bit hashes of its different least parts, about three bytes each, to the hashes' ranges, and gets back a
bit for each: whether another chunk has it too. Only windows whose least part is at two places get their md5 and go on,
so a part that different windows share costs rows but changes no result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of the hashes by which windows are looked for; 2^40 is 100 times the windows of 30 GB.
BITS = 40
#: Share of a window's tokens in one of its parts. Longer parts are more, shorter ones let more windows go on for nothing.
PART = 0.6
#: Bytes of input files for each chunk, and bytes of text that are hashed together.
CHUNK, BLOCK = 2 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse mod 2^64."""
    rows = [np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    for x in rows:
        x[0] = 1
    return np.cumprod(rows[0]), np.cumprod(rows[1])


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """BITS bits of each data[s:e]."""
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * up[: len(data)], out=sums[1:])
    x = (sums[e] - sums[s]) * down[s]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """For each run of n numbers the place of its least one, the first of these."""
    place, width = np.arange(len(x)), 1
    while width < n and len(place):
        step = min(width, n - width)
        a, b = place[:-step], place[step:]
        place, width = np.where(x[b] < x[a], b, a), width + step
    return place


class Chunk:
    """Texts (rows key, t: tokens joined by spaces) in order of their key; windows by document and start, and their least
    parts (hash) by place; `part` numbers each window's."""

    def __init__(self, rows: pa.Table, key: str, size: int):
        rows = rows.take(pc.sort_indices(rows.column(key)))
        self.number = rows.column("chunk")[0].as_py() if len(rows) else None
        self.keys = rows.column(key).combine_chunks().dictionary_encode()
        texts = pc.fill_null(rows.column("t"), "").cast(pa.large_string()).combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        self.keys = self.keys.combine_chunks() if isinstance(self.keys, pa.ChunkedArray) else self.keys
        self.of_row = self.keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.empty(0, np.uint8)
        self.size = size
        blocks = [self._block(a, b) for a, b in self._blocks()]
        self.hash, new, self.row, self.start, self.s, self.e = (np.concatenate([x[i] for x in blocks]) if blocks else np.empty(0, np.int64) for i in range(6))
        self.hash, self.part = self.hash.astype(np.uint64), np.cumsum(new, dtype=np.int32) - 1
        self.different, self.counts = np.unique(self.hash, return_counts=True)

    def _blocks(self):
        a, rows = 0, len(self.offsets) - 1
        while a < rows:
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + BLOCK, "right")) - 1)
            yield a, min(b, rows)
            a = b

    def _block(self, a: int, b: int):
        low = self.offsets[a]
        bounds = self.offsets[a : b + 1] - low
        data = self.data[low : low + bounds[-1]]
        spaces = np.flatnonzero(data == 32)
        some = bounds[1:] > bounds[:-1]
        count = np.diff(np.searchsorted(spaces, bounds)) + some
        begins = np.sort(np.concatenate([bounds[:-1][some], spaces + 1]))
        ends = np.sort(np.concatenate([spaces, bounds[1:][some]]))
        last = np.cumsum(count)
        windows = np.maximum(count - self.size + 1, 0)
        row = np.repeat(np.arange(b - a), windows)
        start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = start + (last - count)[row]
        s, e = begins[at], ends[at + self.size - 1]
        # parts that run over a text's end are in no window
        tokens = max(1, round(self.size * PART))
        parts = _hashes(data, begins[: max(0, len(begins) - tokens + 1)], ends[tokens - 1 :])
        place = _least(parts, self.size - tokens + 1)[at]
        new = np.diff(place, prepend=-1) > 0
        # least hashes are small: spread anew over all their bits
        found = parts[place[new]] * np.uint64(_BASE) >> np.uint64(64 - BITS)
        # places fit 32 bits within a chunk's documents
        return found, new, (row + a).astype(np.int32), start.astype(np.int32), s + low, (e - s).astype(np.int32)

    def splits(self, buckets: int) -> np.ndarray:
        """Bounds of the ranges' hashes among the different ones."""
        return np.searchsorted(self.different, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(BITS)) // np.uint64(buckets))

    def repeated(self, replies: pa.Table, buckets: int):
        """Row, start, and both halves of the md5 of each window that may be repeated, by document and start."""
        again, split = self.counts > 1, self.splits(buckets)
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True):
            n = split[bucket + 1] - split[bucket]
            again[split[bucket] : split[bucket + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        at = np.flatnonzero(again[np.searchsorted(self.different, self.hash)][self.part])
        text, md5 = memoryview(self.data), hashlib.md5
        s, n = self.s[at], self.e[at]
        found = np.empty((len(at), 2), np.int64)
        for i in range(0, len(at), 100_000):
            part = b"".join([md5(text[x : x + y]).digest() for x, y in zip(s[i : i + 100_000].tolist(), n[i : i + 100_000].tolist(), strict=True)])
            found[i : i + 100_000] = np.frombuffer(part, ">i8").reshape(-1, 2)
        return self.row[at], self.start[at].astype(np.int64), found[:, 0], found[:, 1]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of numbers, all lowest bytes first."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(x: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0].astype(np.uint64)


def _packed(x: np.ndarray, width: int = BITS // 8) -> bytes:
    """Rising numbers as their steps."""
    return _planes(np.diff(x, prepend=np.uint64(0)), width)


def _unpacked(x: bytes, width: int = BITS // 8) -> np.ndarray:
    return np.cumsum(_numbers(x, width))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _chunks(df: DataFrame) -> int:
    """Chunks for the files that df reads; 8 a partition where their size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    chunks = -(-size // CHUNK) if size < 1 << 56 else 8 * df.rdd.getNumPartitions()
    return max(chunks, 2 * df.sparkSession.sparkContext.defaultParallelism)


class Found:
    """Chunks of texts and the replies on their windows, to be met by over()."""

    def __init__(self, df: DataFrame, tokens: Column, size: int, key: str):
        chunks = _chunks(df)
        buckets = self.buckets = max(8, chunks // 4)
        self.key, self.size, self.kind = key, size, dict(df.dtypes)[key]
        self.texts = df.select(F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"), key, F.array_join(tokens, " ").alias("t"))

        def told(rows: pa.Table) -> pa.Table:
            chunk = Chunk(rows, key, size)
            split = chunk.splits(buckets)
            some = [i for i in range(buckets) if split[i + 1] > split[i]]
            return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(some), pa.int32()), "hashes": pa.array([_packed(chunk.different[split[i] : split[i + 1]]) for i in some], pa.binary())})

        def met(rows: pa.Table) -> pa.Table:
            each = [_unpacked(x) for x in rows.column("hashes").to_pylist()]
            every = np.sort(np.concatenate(each))
            twice = every[1:][every[1:] == every[:-1]]
            twice = twice[changes(twice)]
            ends = np.append(twice, np.uint64((1 << 64) - 1))
            bits = [np.packbits(ends[np.searchsorted(twice, x)] == x).tobytes() for x in each]
            return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

        hashes = self.texts.groupBy("chunk").applyInArrow(told, "bucket int, chunk int, hashes binary")
        self.replies = hashes.groupBy("bucket").applyInArrow(met, "chunk int, bucket int, bits binary")

    def over(self, work, schema: str) -> DataFrame:
        """work(chunk, rows, starts, a, b) of each chunk, to a table."""
        key, size, buckets = self.key, self.size, self.buckets

        def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
            chunk = Chunk(rows, key, size)
            return work(chunk, *chunk.repeated(replies, buckets))

        return self.texts.groupBy("chunk").cogroup(self.replies.groupBy("chunk")).applyInArrow(run, schema)

    def again(self, later: DataFrame, work, schema: str) -> DataFrame:
        """over() with the rows of later(chunk, ...) as another argument."""
        key, size, buckets = self.key, self.size, self.buckets

        def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
            chunk = Chunk(rows, key, size)
            return work(chunk, replies.filter(pc.is_null(replies.column("bits"))), *chunk.repeated(replies.filter(pc.is_valid(replies.column("bits"))), buckets))

        both = self.replies.unionByName(later, allowMissingColumns=True)
        return self.texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(run, schema)


def hexed(a: str = "a", b: str = "b") -> Column:
    """The md5 as text from its halves."""
    return F.concat(*[F.lower(F.lpad(F.hex(x), 16, "0")) for x in (a, b)])


def places(df: DataFrame, tokens: Column, size: int, key: str, gap: int) -> DataFrame:
    """(a, b, n, documents, kept, first, skipped) of each chunk's windows that may be repeated: n places, in so many
    documents, kept of them by those that begin `gap` tokens or more after the last kept one of their document; the
    first place (key, start) and the windows that begin less than `gap` tokens after it. Tokens hold no spaces."""
    found = Found(df, tokens, size, key)
    kind = found.kind

    def work(chunk: Chunk, row, start, a, b) -> pa.Table:
        doc = chunk.of_row[row]
        order = np.lexsort((start, doc, b, a))
        a, b, doc, start = a[order], b[order], doc[order], start[order]
        runs = changes(a, b, doc)
        ends = np.append(runs[1:], len(a))
        # all documents' windows step on together
        run_of = np.repeat(np.arange(len(runs)), ends - runs)
        wide = np.int64(1) << np.int64(32)
        line = run_of * wide + start
        kept, skipped = np.ones(len(runs), np.int64), np.zeros(len(runs), np.int64)
        going, at = np.flatnonzero(ends - runs > 1), runs
        at = at[going]
        first = True
        while len(going):
            on = np.searchsorted(line, going * wide + start[at] + gap)
            if first:
                skipped[going], first = on - at - 1, False
            left = on < ends[going]
            going, at = going[left], on[left]
            kept[going] += 1
        grams = changes(a[runs], b[runs])
        at = runs[grams]
        total = lambda x: np.add.reduceat(x, grams) if len(grams) else np.empty(0, np.int64)
        names = chunk.keys.dictionary.take(pa.array(doc[at]))
        columns = [pa.array(a[at]), pa.array(b[at]), pa.array(total(ends - runs)), pa.array(total(np.ones(len(runs), np.int64))), pa.array(total(kept)), names, pa.array(start[at]), pa.array(skipped[grams])]
        return pa.table(columns, names=["a", "b", "n", "documents", "kept", key, "start", "skipped"])

    return found.over(work, f"a long, b long, n long, documents long, kept long, {key} {kind}, start long, skipped long")


class Classes:
    """A chunk's windows that may be repeated, by class: first place of each, class of each place, places and documents."""

    def __init__(self, chunk: Chunk, row, start, a, b):
        x, y, doc = a.view(np.uint64), b.view(np.uint64), chunk.of_row[row]
        order = np.lexsort((doc, y, x))
        runs = changes(x[order], y[order])
        self.first, self.places = order[runs], np.diff(np.append(runs, len(order)))
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(runs)), self.places)
        new = np.zeros(len(order), np.int64)
        new[changes(x[order], y[order], doc[order])] = 1
        self.documents = np.add.reduceat(new, runs) if len(runs) else np.empty(0, np.int64)
        # 96 bits name a class among chunks
        self.a, self.b = x[self.first], y[self.first] & np.uint64((1 << 32) - 1)
        follows = np.zeros(len(row), bool)
        follows[1:] = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
        mark = (y & np.uint64((1 << 48) - 1)) | np.uint64(1)
        before, after = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
        before[1:] = np.where(follows[1:], mark[:-1], np.uint64(0))
        after[:-1] = np.where(follows[1:], mark[1:], np.uint64(0))
        self.before, self.after = (_common(m[order], runs) for m in (before, after))

    def splits(self, buckets: int) -> np.ndarray:
        return np.searchsorted((self.a >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1))


def _common(marks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The mark that all of a run's rows have, else 0, which stands for none."""
    if not len(runs):
        return np.empty(0, np.uint64)
    low, high = np.minimum.reduceat(marks, runs), np.maximum.reduceat(marks, runs)
    return np.where(low == high, low, np.uint64(0))


def lengths(df: DataFrame, tokens: Column, size: int, key: str) -> DataFrame:
    """(a, b, occurrences, documents, length, maximal) of windows that occur twice or more, as repeat_groups() has them.

    A class is further where all its places go on with one window. Chunks tell their classes with 48-bit marks of the
    windows before and after, and get a bit back for each that is; lengths are then counted within a document, as steps
    to the next window that isn't. Of the chunks that hold a class the first returns it. Tokens hold no spaces."""
    found = Found(df, tokens, size, key)
    buckets = found.buckets
    widths = {"a": 8, "b": 4, "before": 6, "after": 6, "places": 5, "documents": 5}

    def told(chunk: Chunk, row, start, a, b) -> pa.Table:
        c = Classes(chunk, row, start, a, b)
        split = c.splits(buckets)
        some = [i for i in range(buckets) if split[i + 1] > split[i]]
        out = {"bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk.number] * len(some), pa.int32())}
        for name, width in widths.items():
            out[name] = pa.array([(_packed if name == "a" else _planes)(getattr(c, name)[split[i] : split[i + 1]], width) for i in some], pa.binary())
        return pa.table(out)

    def met(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("chunk")))
        each = {n: [(_unpacked if n == "a" else _numbers)(x, w) for x in rows.column(n).to_pylist()] for n, w in widths.items()}
        size_of = [len(x) for x in each["a"]]
        every = {n: np.concatenate(x) for n, x in each.items()}
        order = np.lexsort((np.arange(len(every["a"])), every["b"], every["a"]))
        runs = changes(every["a"][order], every["b"][order])
        n, documents = (np.add.reduceat(every[x][order], runs) for x in ("places", "documents"))
        before, after = (_common(every[x][order], runs) for x in ("before", "after"))
        code = np.where(n >= 2, (after > 0) * 1 + (before == 0) * 2, 0).astype(np.uint8)
        codes, own = np.empty(len(order), np.uint8), order[runs][n >= 2]
        codes[order] = np.repeat(code, np.diff(np.append(runs, len(order))))
        codes[own] |= 4
        totals = {"occurrences": np.zeros(len(order), np.uint64), "documents": np.zeros(len(order), np.uint64)}
        totals["occurrences"][own], totals["documents"][own] = n[n >= 2], documents[n >= 2]
        ends = np.cumsum([0, *size_of])
        parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = {"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "codes": pa.array([codes[p].tobytes() for p in parts], pa.binary())}
        for name, x in totals.items():
            out[name] = pa.array([_planes(x[p][codes[p] >= 4], 5) for p in parts], pa.binary())
        return pa.table(out)

    def counted(chunk: Chunk, replies: pa.Table, row, start, a, b) -> pa.Table:
        c = Classes(chunk, row, start, a, b)
        split = c.splits(buckets)
        codes = np.zeros(len(c.a), np.uint8)
        totals = {x: np.zeros(len(c.a), np.int64) for x in ("occurrences", "documents")}
        for r in replies.select(["bucket", "codes", *totals]).to_pylist():
            part = slice(split[r["bucket"]], split[r["bucket"] + 1])
            codes[part] = np.frombuffer(r["codes"], np.uint8)
            for name, x in totals.items():
                x[part][codes[part] >= 4] = _numbers(r[name], 5)
        own = np.flatnonzero(codes >= 4)
        stops = np.flatnonzero(codes[c.of] & 1 == 0)
        at = c.first[own]
        steps = stops[np.searchsorted(stops, at)] - at
        columns = [a[at], b[at], totals["occurrences"][own], totals["documents"][own], steps + size, codes[own] & 2 > 0]
        return pa.table([pa.array(x) for x in columns], names=["a", "b", "occurrences", "documents", "length", "maximal"])

    blobs = ", ".join(f"{x} binary" for x in widths)
    classes = found.over(told, f"bucket int, chunk int, {blobs}")
    replies = classes.groupBy("bucket").applyInArrow(met, "chunk int, bucket int, codes binary, occurrences binary, documents binary")
    return found.again(replies, counted, "a long, b long, occurrences long, documents long, length long, maximal boolean")
