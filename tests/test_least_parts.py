"""Windows are looked for by their least parts, a few hashes for many windows; no repeat is lost by that."""

import collections

import numpy as np
import pyarrow as pa

from glyphmill.operators import shingled

NONE = pa.table({"bucket": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})


def chunk(texts, size):
    return shingled.Chunk(pa.table({"chunk": pa.array([0] * len(texts), pa.int32()), "file": list(range(len(texts))), "t": texts}), "file", size)


def test_fewer_hashes_than_windows():
    draw = np.random.default_rng(1)
    c = chunk([" ".join(map(str, draw.integers(0, 10**6, 400))) for _ in range(50)], 20)
    assert len(c.row) == 50 * 381 and len(c.different) < len(c.row) / 4


def test_no_repeat_is_lost():
    """Within a chunk and between two; short alphabets and periods, in which windows overlap their copies."""
    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, k, int(n)))) for k in (1, 2, 3) for n in draw.integers(0, 40, 12)] + ["a b " * 9 + "c", "a b c " * 5, "", None]
    words = [(t or "").split() for t in texts]
    for size in (1, 2, 3, 5, 12):
        windows = [[" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] for w in words]
        c = chunk([" ".join(w) for w in words], size)
        row, start, _, _ = c.repeated(NONE, 1)
        times = collections.Counter(x for w in windows for x in w)
        assert {(r, i) for r, w in enumerate(windows) for i, x in enumerate(w) if times[x] > 1} <= set(zip(row.tolist(), start.tolist(), strict=True))
        halves = [chunk([" ".join(w) for w in words[i::2]], size) for i in (0, 1)]
        both = set(halves[0].different.tolist()) & set(halves[1].different.tolist())
        shared = {x for w in windows[::2] for x in w} & {x for w in windows[1::2] for x in w}
        for i, half in enumerate(halves):
            met = [int(x) in both for x in half.hash]
            assert all(met[p] for p, r, s in zip(half.part, half.row, half.start, strict=True) if windows[i::2][r][s] in shared)
