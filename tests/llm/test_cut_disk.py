"""What a cut reads goes from the disk with it."""

import time

from pyspark.sql import functions as F

from glyphmill.llm.common import cut
from glyphmill.llm.near_dedup import near_duplicates


def _shuffles(spark) -> int:
    """Shuffle files that the session holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return sum("/shuffle_" in x and x.endswith(".data") for x in files.splitlines())


def _settled(spark, most: int) -> int:
    """Their number once it is down to `most`, else after ten seconds."""
    for _ in range(100):
        if (n := _shuffles(spark)) <= most:
            break
        time.sleep(0.1)
    return n


def test_a_cut_drops_its_shuffles(spark):
    before, setting = _shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    out = cut(df)
    assert _settled(spark, before) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    # both can be read again
    assert out.agg(F.sum("count")).first()[0] == df.agg(F.sum("count")).first()[0] == 1000


def test_near_duplicates_leave_no_shuffles(spark):
    """Dozens of rounds are cut; the files of none pile up until the result is read, only rows of single counts stay."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: i % 5], *words, f"x{i // 50}"])) for i in range(200)]
    before = _shuffles(spark)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3)
    assert _settled(spark, before + 20) <= before + 20
    got = out.collect()
    assert len(got) == 200 and sum(r.kept for r in got) == len({r.component_id for r in got}) < 20
