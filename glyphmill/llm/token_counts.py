"""Token counts of byte-level BPE by rank-synchronous array merging.

Pre-tokens of a batch that have not been seen are held as one ragged numpy array of symbols. Each step finds
every sequence's lowest-rank pair and merges all its places in all sequences at once, until no sequence has
a pair with a rank. The count of a pre-token is the number of its symbols that survive.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import extended, prepare, slices, table, without

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Known pre-tokens that a Python worker holds at most; when there are more, it starts anew.
MOST_KNOWN = 1 << 19
_NO_RANK = np.int64(1 << 40)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as a printable letter: itself where it is printable, else the
    next free code point from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[c] for _, c in sorted(_byte_letters().items())], np.int64)
        # The library's \s is Unicode's White_Space.
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}

    def merged(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token (none may be empty)."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(c) for c in coded], np.int64)
        symbols = self.byte[np.frombuffer(b"".join(coded), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        while len(symbols) > 1:
            key = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = of[:-1] == of[1:]
            rank = np.where((self.keys[at] == key) & same, self.ranks[at], _NO_RANK)
            # pairs by sequence: the last symbol's place of each sequence has no pair of its own
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, _NO_RANK), starts)
            by_symbol = np.repeat(lowest, np.diff(np.append(starts, len(of))))
            take = (rank == by_symbol[:-1]) & (rank < _NO_RANK)
            if not take.any():
                break
            # of overlapping places (x x x) every second one from the left is merged
            places = np.flatnonzero(take)
            first = np.r_[True, np.diff(places) != 1]
            offset = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[offset % 2 == 0]
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            counts -= np.bincount(of[places], minlength=len(words))
            # sequences without a pair of any rank are done
            keep &= by_symbol < _NO_RANK
            symbols, of = symbols[keep], of[keep]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        extra, split = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append([w for p in parts for w in self.pattern.findall(p)] if len(parts) > 1 else self.pattern.findall(text))
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        known = self.known
        if new := sorted(set().union(*split) - known.keys()):
            known.update(zip(new, self.merged(new).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, words)) for n, words in zip(extra, split, strict=True)]


@functools.cache
def load(name: str) -> ByteBpe:
    """The vocabulary file of that name, where the library of public tokenizers has it (read on each executor)."""
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(name), public_tokenizers.PATTERN)


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of the whole text.

    Null and empty texts count 0. A special token's string inside a text is one token. A row in, a row out;
    columns with those names are replaced.
    """
    prepare(df.sparkSession)
    df = without(df, "n_bytes", "n_tokens", "over_limit")

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                n = bpe.count(texts)
                columns = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[*part.schema.names, "n_bytes", "n_tokens", "over_limit"],
                )

    return df.mapInArrow(run, extended(df, n_bytes="long", n_tokens="long", over_limit="boolean"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
