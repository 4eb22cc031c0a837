"""Signatures with their sets' digests, and pairs that share a band."""

from pyspark.sql import functions as F

from glyphmill.operators import discovery, minhash


def test_signed_sets(spark):
    df = spark.createDataFrame([(1, [5, 3, 9]), (2, [9, 5, 3]), (3, [5]), (4, []), (5, None)], "id long, hashes array<long>")
    got = {r.id: (bytes(r.digest), r.sig) for r in minhash.signed_sets(df, 16).collect()}
    assert {k: v[1] for k, v in got.items()} == {r.id: r.s for r in df.select("id", minhash.signature(F.col("hashes"), 16).alias("s")).collect()}
    assert got[1] == got[2] and len({v[0] for v in got.values()}) == 3


def test_all_similar_meets_by_bands(spark):
    """Rows that share single places only are never paired."""
    sigs = [(i, [1] * 8 + [100 * i + j for j in range(8, 40)]) for i in range(50)]
    df = spark.createDataFrame(sigs, "id long, sig array<long>")
    out = discovery.all_similar(df, 40, 0.8)
    assert out.count() == 0
    assert "slice(sig" in out._jdf.queryExecution().logical().toString()
