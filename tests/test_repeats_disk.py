"""Long repeats are found without copies of all classes on disk."""

import os

from pyspark.sql import functions as F

from glyphmill.operators import repeats
from glyphmill.plans import extended

from .conftest import SF


def test_no_rounds_of_classes_are_written(spark):
    """One long repeat that ends in three ways, in many documents; nothing is left in the checkpoint folder."""
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, f"{text} e{i % 3} x{i}") for i in range(60)], "file long, text string")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = sorted(os.listdir(folder))
    out = repeats.repeat_groups(df, F.split("text", " "), 4).collect()
    assert sorted(os.listdir(folder)) == before
    common = [r for r in out if r.occurrences == 60]
    assert len(common) == 297 and sorted(r.length for r in common) == list(range(4, 301)) and sum(r.maximal for r in common) == 1
    assert {(r.occurrences, r.documents, r.length, r.maximal) for r in out if r.occurrences != 60} == {(20, 20, 4, False)}
    assert len(out) == 300


def test_maximal_repeats_query_leaves_no_copies(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = sorted(os.listdir(folder))
    rows = extended.maximal_repeats(spark, SF).select(F.count("*").alias("n"), F.min("occurrences").alias("least"), F.min("length").alias("short")).first()
    assert rows.n and rows.least >= 2 and rows.short >= 20 and sorted(os.listdir(folder)) == before
