"""Queries over whole tables: against their SQL without its cuts, or against naive versions."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.operators import embeddings, minhash
from glyphmill.plans import similar
from glyphmill.registry import QUERIES

from .conftest import SF


def test_all_minima(spark):
    a, b = (x.tolist() for x in minhash.coefficients(256))
    fold = lambda x: (x & minhash.MERSENNE) + (x >> 61)
    docs = {r.id: r.hashes for r in similar.hashes(spark, SF).collect()}
    found = {(r.id, r.i): r.value for r in QUERIES["m3_signatures"](spark, SF).collect()}
    assert len(found) == 256 * len(docs)
    for doc in sorted(docs, key=lambda x: len(docs[x]))[::20]:
        for i in range(256):
            want = min(y - minhash.MERSENNE if (y := fold((a[i] * x + b[i]) % (1 << 64))) >= minhash.MERSENNE else y for x in docs[doc])
            assert found[doc, i] == want


def test_signatures_of_all_documents(spark):
    docs = {r.id: r.hashes for r in similar.hashes(spark, SF).collect()}
    ids = sorted(docs)
    a, b = (np.array(x, np.uint64)[:, None] for x in minhash.coefficients(256))
    modulus = np.uint64(minhash.MERSENNE)

    def minima(x):
        y = a * np.array(x, np.uint64)[None, :] + b
        y = (y & modulus) + (y >> np.uint64(61))
        return np.where(y >= modulus, y - modulus, y).min(axis=1)

    sigs = np.array([minima(docs[i]) for i in ids])
    bands, rows = minhash.bands_and_rows(256, 0.5)
    first, pairs, near = {}, set(), {}
    for i in ids:
        first.setdefault(frozenset(docs[i]), i)
    reps = set(first.values())
    for x, k in enumerate(ids):
        same = sigs == sigs[x]
        for y in np.flatnonzero(same[:, : bands * rows].reshape(len(ids), bands, rows).all(2).any(1)):
            if k < ids[y] and k in reps and ids[y] in reps:
                pairs.add((k, ids[y]))
            if k % 20 == 0 and y != x and same[y].mean() >= 0.5:
                near[k, ids[y]] = same[y].mean()
    assert {(r.id1, r.id2) for r in QUERIES["m9_candidates"](spark, SF).collect()} == pairs
    assert {(r["query"], r.id): r.similarity for r in QUERIES["m10_similar_to"](spark, SF).collect()} == near
    at = dict(zip(ids, sigs, strict=True))
    assert {r.id: r.similarity for r in QUERIES["m4_estimate"](spark, SF).collect()} == {k: (at[k] == at[k + 1]).mean() for k in ids if k + 1 in at}


def test_least_cosine_of_all_members(spark):
    v = np.random.default_rng(5).normal(size=(60, 3))
    df = spark.createDataFrame([(i, v[i].tolist(), i % 2) for i in range(60)] + [(60, [1.0, 0.0, 0.0], 2)], "id long, v array<double>, module int")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    found = {r.module: r.least for r in embeddings.least_cosines(df, "module", block=7).collect()}
    assert found == pytest.approx({m: (unit[m::2] @ unit[m::2].T).min() for m in (0, 1)})


def _tokens(spark, table, key):
    item = F.transform(text.tokens(F.col("text")), lambda t: F.struct(text.token_kind(t), t))
    return {r[0]: [tuple(t) for t in r[1]] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key, item).collect()}


def test_all_positional_blocks(spark):
    want = set()
    for doc, found in _tokens(spark, "documents", "doc_id").items():
        for start in range(0, len(found) - 39, 20):
            names, form = {"identifier": {}, "literal": {}}, []
            for kind, t in found[start : start + 40]:
                known = names.get(kind)
                form.append(t if known is None else ("$ID" if kind == "identifier" else "$LIT") + str(known.setdefault(t, len(known))))
            want.add((doc, start, " ".join(form)))
    rows = QUERIES["x8_positional_blocks"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.start, r.form) for r in rows} == want


def test_all_passages_of_items(spark):
    items, want = defaultdict(set), set()
    for item, found in _tokens(spark, "benchmark", "item_id").items():
        for i in range(len(found) - 7):
            items[tuple(t for _, t in found[i : i + 8])].add(item)
    for doc, found in _tokens(spark, "documents", "doc_id").items():
        for i in range(len(found) - 7):
            want |= {(item, doc, i) for item in items.get(tuple(t for _, t in found[i : i + 8]), ())}
    rows = QUERIES["c5_pattern_search"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.pattern_id, r.file, r.start) for r in rows} == want


def test_all_lines_as_groups(spark):
    places, first = defaultdict(set), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for line in r.text.split("\n"):
            places[hashlib.md5(line.encode()).hexdigest()].add(f"{r.source}:{r.lang}")
    for group, found in sorted(places.items()):
        first.setdefault("|".join(sorted(found)), group)
    assert {r.locations: r.group for r in QUERIES["c13_dedupe"](spark, SF).collect()} == first
