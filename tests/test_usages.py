"""A report of one long file."""

from pyspark.sql import functions as F

from glyphmill.operators import reports


def test_usages_text_of_a_long_file(spark):
    df = spark.range(100_000).select(F.lit("f").alias("file"), (F.col("id") % 100).cast("int").alias("line"), F.col("id").alias("col"), F.when(F.col("id") % 2 == 0, "écrit").alias("kind"))
    (row,) = reports.usages_text(df).collect()
    lines, length = [[]], 2
    for n, c in sorted((i % 100, i) for i in range(100_000)):
        item = f"{n}:{c}({'écr' if c % 2 == 0 else 'null'}) "
        if length + len(item) - 1 > 100:
            lines, length = [*lines, []] if len(lines) < 2 else (lines.append([]) or lines), 2
        lines[-1].append(item)
        length += len(item)
    assert row.report == "\n".join("  " + "".join(x) for x in lines)
