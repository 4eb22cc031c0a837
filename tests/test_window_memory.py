"""Windows are hashed in blocks of texts, not a whole batch at once; one window's text tells its counts."""

import numpy as np
import pyarrow as pa

from glyphmill.operators import shingled


def test_blocks_are_bounded(monkeypatch):
    """Hashes and places don't hang on the blocks; a block has BLOCK bytes or one document."""
    draw = np.random.default_rng(2)
    texts = [" ".join(map(str, draw.integers(0, 9, int(n)))) for n in draw.integers(0, 60, 80)] + [None, "", "one"]
    rows = pa.table({"chunk": pa.array([0] * len(texts), pa.int32()), "file": list(range(len(texts))), "t": texts})
    whole = shingled.Chunk(rows, "file", 4)
    sizes, block = [], shingled.Chunk._block
    monkeypatch.setattr(shingled, "BLOCK", 100)
    monkeypatch.setattr(shingled.Chunk, "_block", lambda self, a, b: sizes.append((int(self.offsets[b] - self.offsets[a]), b - a)) or block(self, a, b))
    small = shingled.Chunk(rows, "file", 4)
    for name in ("hash", "row", "start", "s", "e"):
        assert np.array_equal(getattr(whole, name), getattr(small, name))
    assert len(sizes) > 20 and all(n <= 100 or rows == 1 for n, rows in sizes)
    got = [texts[r][s - whole.offsets[r] : s - whole.offsets[r] + e] for r, s, e in zip(whole.row, whole.s, whole.e, strict=True)]
    assert got == [" ".join(t.split()[i : i + 4]) for t in texts for i in range(len((t or "").split()) - 3)]
