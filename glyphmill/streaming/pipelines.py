"""Streams: deduplication with bounded state, and incremental state kept by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive; the source's pace bounds a batch (back-pressure), and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key. With a time column the state of keys older than the delay is let go."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def incremental(stream: DataFrame, step, state_path: str, checkpoint: str) -> StreamingQuery:
    """Runs step(batch, state or None) -> new state on every micro-batch; the state is a table under state_path, one
    folder a batch, so a batch that is run again writes the same folder again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/batch={number - 1}") if number else None
        step(batch, state).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
