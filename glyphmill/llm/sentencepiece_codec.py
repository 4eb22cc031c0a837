"""SentencePiece encoding and decoding by suffix-array matching.

White space becomes U+2581 and one is put before the text, as the model says. No piece crosses from another
character into U+2581 or a line feed, so a text is a sequence of units that are encoded alone, and a batch needs
each distinct unit once. The new units of a batch are concatenated and indexed by a suffix array (prefix
doubling); every piece of the model is binary-searched for its range of occurrences; the ranges give edges
(start, end, piece) of the units' lattices, which are sorted by position and relaxed from left to right, for
all units of the index at once.

The model is a BPE one: its segmentation is not the one of the highest score, but the one that merging makes.
So an edge relaxes its end only if its piece can follow the last piece of its start, that is, if merging the
two pieces' characters gives just these two. By induction a place then has one last piece: that of the
merged prefix. Whether pieces can follow each other is read from their last merges: undoing the later one of the two again and
again, no pair that meets at the boundary may be a piece that would have been merged before what was undone. What stays
unreached (or begins with several spaces, whose pieces have equal scores) is merged directly.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import extended, prepare, slices, table, without

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units that a Python worker remembers at most; when there are more, the older half goes.
MOST_KNOWN = 1 << 17
#: Slots for pairs of pieces that may or may not follow each other; a slot keeps the last pair.
SLOTS = 1 << 20
#: Characters in one suffix array, where a unit is not longer.
INDEX_CHARS = 1 << 19
#: Longer units are relaxed one edge after the other.
LONG_UNIT = 256
#: Bytes of texts that a task encodes at once, where a text is not longer.
STEP_BYTES = 1 << 20
_UNITS = regex.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of text's suffixes in the order of their first `depth` bytes at least (what lies beyond the end is
    smaller than any byte), by prefix doubling from eight bytes on."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j].astype(np.uint64)
    length = 8
    while True:
        order = np.argsort(key, kind="stable")
        inner = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[True, inner[1:] != inner[:-1]])
        if length >= depth or rank.max(initial=0) == n:
            return order
        later = np.zeros(n, np.uint64)
        later[: max(0, n - length)] = rank[length:]
        key = (rank << np.uint64(32)) | later
        length *= 2


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without normalisation are encoded")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (p.NORMAL, p.USER_DEFINED):
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(spec.unk_surface.encode() if p.type == p.UNKNOWN else b"")
        crossing = [p for p in self.id if len(p) > 1 and ("\n" in p or (SPACE in p[1:] and p.strip(SPACE)))]
        if crossing:
            raise ValueError(f"pieces cross units: {crossing[:3]}")
        if any("\x00" in p for p in self.id):
            raise ValueError("a piece holds the separator of units")
        self._table()
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_may = np.zeros(SLOTS, bool)

    def _table(self) -> None:
        """Pieces in the order of their bytes, as numbers, with the last merge of each; n stands for any unknown
        character, -1 for no piece. Ranks grow from the first merge on, characters have 0."""
        steps: dict[str, tuple[str, str] | None] = {}
        for p in self.id:
            made: list[tuple[str, str]] = []
            if self.merge(p, made) == [p]:  # others never come up
                steps[p] = made[-1] if made else None
        coded = sorted((p.encode(), p) for p in steps)
        self.pieces = [p for _, p in coded]
        number = {p: i for i, p in enumerate(self.pieces)}
        self.n = n = len(self.pieces)
        self.depth = max(len(b) for b, _ in coded)
        self.low = np.array([b for b, _ in coded], f"S{self.depth}")
        self.high = np.array([b.ljust(self.depth, b"\xff") for b, _ in coded], f"S{self.depth}")
        self.lengths = np.array([*[len(p) for p in self.pieces], 1])
        order = {x: i + 1 for i, x in enumerate(sorted({self.score[p] for p in self.pieces if steps[p]}, reverse=True))}
        self.rank = np.array([*[order[self.score[p]] if steps[p] else 0 for p in self.pieces], 0], np.int64)
        self.first = np.array([*[number[steps[p][0]] if steps[p] else -1 for p in self.pieces], -1])
        self.second = np.array([*[number[steps[p][1]] if steps[p] else -1 for p in self.pieces], -1])
        pairs = sorted((number[p[:i]] * (n + 1) + number[p[i:]], self.rank[number[p]]) for p in self.pieces for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.number = np.array([*[self.id[p] for p in self.pieces], -1], np.int32)
        self.letters = np.array(sorted(ord(p) for p in self.pieces if len(p) == 1), np.uint32)

    def merge(self, text: str, made: list[tuple[str, str]] | None = None) -> list[str]:
        """Pieces (or single unknown characters) by merging: always the adjacent pair whose union has the
        highest score, the leftmost of equal ones. made: gets the pairs in the order of their merges."""
        symbols = list(text)
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(both := symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-s, a, b, both))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or after[a] != b or symbols[a] + symbols[b] != both:
                continue
            if made is not None:
                made.append((symbols[a], symbols[b]))
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s]

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b gives just these two."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = a * (self.n + 1) + b
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            bad = (self.pair[place] == key) & (self.pair_rank[place] < limit)
            out[at[bad]] = False
            ranks_a, ranks_b = self.rank[a], self.rank[b]
            go = ~bad & ((ranks_a > 0) | (ranks_b > 0))
            a, b, at, ranks_a, ranks_b = a[go], b[go], at[go], ranks_a[go], ranks_b[go]
            left = ranks_a > ranks_b
            # of equal merges the one further left comes first
            limit = np.where(left, ranks_a, ranks_b + 1)
            a, b = np.where(left, self.second[a], a), np.where(left, b, self.first[b])
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_follows(), remembered in slots."""
        key = a * (self.n + 1) + b
        slot = ((key * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(40)) & np.int64(SLOTS - 1)
        missing = np.flatnonzero(self.slot_key[slot] != key)
        out = self.slot_may[slot]
        if len(missing):
            new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            may = self._follows(a[missing[first]], b[missing[first]])
            out[missing] = may[back]
            self.slot_key[slot[missing[first]]] = new
            # two new keys of one slot: the last one's key stays, and its answer with it
            self.slot_may[slot[missing[first]]] = may
        return out

    def _edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, piece) of all edges in the units' joined text, sorted by position, and each unit's beginning."""
        joined = "\x00".join(units) + "\x00"
        text = np.frombuffer(joined.encode(), np.uint8)
        order = suffix_array(text, self.depth)
        padded = np.zeros(len(text) + self.depth, np.uint8)
        padded[: len(text)] = text
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order]
        windows = np.ascontiguousarray(windows).view(f"S{self.depth}").ravel()
        first, stop = np.searchsorted(windows, self.low, "left"), np.searchsorted(windows, self.high, "right")
        counts = stop - first
        piece = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        # places in characters
        place = (np.cumsum((text & 0xC0) != 0x80) - 1)[order[np.repeat(first, counts) + inner]]
        begins = np.cumsum([0, *[len(u) + 1 for u in units]])
        letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        unknown = self.letters[at] != letters
        unknown[begins[1:] - 1] = False  # the separators
        unknown = np.flatnonzero(unknown)
        place, piece = np.concatenate([place, unknown]), np.concatenate([piece, np.full(len(unknown), self.n)])
        by = np.argsort(place, kind="stable")
        return place[by], piece[by], begins

    def _relax(self, last: np.ndarray, start: np.ndarray, piece: np.ndarray, first: bool) -> None:
        """Relaxes edges of one position in each of several units."""
        end = start + self.lengths[piece]
        go = last[end] < 0 if first else (last[end] < 0) & (last[start] >= 0)
        start, end, piece = start[go], end[go], piece[go]
        if not first:
            may = self.may_follow(last[start], piece)
            end, piece = end[may], piece[may]
        last[end] = piece

    def _index(self, units: list[str]) -> None:
        """Encodes the units and remembers their ids."""
        place, piece, begins = self._edges(units)
        sizes = np.diff(begins) - 1
        of = np.repeat(np.arange(len(units)), sizes + 1)
        inside = place - begins[of[place]]
        # last[begins[i] + j]: last piece of the unit's first j characters; the place after them is the separator's
        last = np.full(begins[-1] + 1, -1)
        short = sizes[of[place]] <= LONG_UNIT
        by = np.flatnonzero(short)[np.argsort(inside[short], kind="stable")]
        bounds = np.searchsorted(inside[by], np.arange(LONG_UNIT + 1))
        for j in range(LONG_UNIT):
            if bounds[j] == len(by):
                break
            edges = by[bounds[j] : bounds[j + 1]]
            self._relax(last, place[edges], piece[edges], j == 0)
        for i in np.flatnonzero(sizes > LONG_UNIT).tolist():
            a, b = np.searchsorted(place, [begins[i], begins[i + 1] - 1]).tolist()
            steps = np.searchsorted(place[a:b], np.arange(begins[i], begins[i + 1])) + a
            for j, (x, y) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)):
                self._relax(last, place[x:y], piece[x:y], j == 0)
        # back from the ends, the last pieces of all units at once
        left = np.flatnonzero(last[begins[:-1] + sizes] >= 0)
        now, found, which = (begins[:-1] + sizes)[left], [], []
        while len(left):
            got = last[now]
            found.append(got)
            which.append(left)
            now = now - self.lengths[got]
            more = now > begins[left]
            left, now = left[more], now[more]
        which, found = (np.concatenate(x[::-1]) if x else np.empty(0, np.int64) for x in (which, found))
        by = np.argsort(which, kind="stable")
        which, found = which[by], found[by]
        bounds = np.searchsorted(which, np.arange(len(units) + 1)).tolist()
        odd = np.zeros(len(units), bool)
        odd[which[found == self.n]] = True
        odd[np.diff(bounds) == 0] = True
        ids = self.number[found]
        raw, width = ids.tobytes(), ids.itemsize
        for i, unit in enumerate(units):
            a, b = bounds[i], bounds[i + 1]
            if not odd[i] and not unit.startswith(SPACE * 2):
                self.known[unit] = raw[a * width : b * width]
            elif a == b or unit.startswith(SPACE * 2):
                self.known[unit] = self._ids(self.merge(unit))
            else:  # with unknown characters
                out, at = [], 0
                for x in found[a:b].tolist():
                    out.append(unit[at : at + int(self.lengths[x])])
                    at += len(out[-1])
                self.known[unit] = self._ids(out)

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode()]
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, without begin and end; an empty text has none."""
        split = [_UNITS.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MOST_KNOWN // 2:
            self.known_before, self.known = self.known, {}
        known, before = self.known, self.known_before
        batch, size = [], 0
        for u in sorted(set().union(*split) - known.keys()):
            if u in before:
                known[u] = before[u]
                continue
            batch.append(u)
            size += len(u)
            if size >= INDEX_CHARS:
                self._index(batch)
                batch, size = [], 0
        if batch:
            self._index(batch)
        return [np.frombuffer(b"".join([known[u] for u in units]), np.int32) for units in split]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.cache
def load(name: str) -> PieceModel:
    """The model file of that name, where the library of public tokenizers has it (read on each executor)."""
    import public_tokenizers

    return PieceModel(public_tokenizers.path(name))


def encode(df: DataFrame, text: str = "text", model: str = MODEL, read_back: bool = False) -> DataFrame:
    """df with piece_ids (array<int>) of the whole text and, if asked, decoded (their text, read back in the same
    pass). Null and empty texts have no pieces. A row in, a row out; columns of these names are replaced."""
    prepare(df.sparkSession)
    added = {"piece_ids": "array<int>"} | ({"decoded": "string"} if read_back else {})
    df = without(df, *added)

    def run(batches):
        own = load(model)
        for batch in batches:
            for part in slices(batch, text, STEP_BYTES):
                ids = own.encode([t or "" for t in part.column(text).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                new = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))]
                if read_back:
                    new.append(pa.array([own.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns)], *new], names=[*part.schema.names, *added])

    return df.mapInArrow(run, extended(df, **added))


def decode(df: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """df with decoded, the text of the ids; null ids give null, ids that the model lacks are left out."""
    prepare(df.sparkSession)
    df = without(df, "decoded")

    def run(batches):
        own = load(model)
        n = len(own.surface)
        for batch in batches:
            texts = [own.decode([i for i in x.as_py() if i is not None and 0 <= i < n]) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, extended(df, decoded="string"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, read_back=True)
    return out.selectExpr("doc_id", "cast(size(piece_ids) as bigint) as n_pieces", "piece_ids", "decoded", "decoded = coalesce(text, '') as round_trip")
