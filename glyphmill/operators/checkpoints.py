"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

_SETTING = "spark.checkpoint.dir"
_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def folder(master: str, setting: str | None) -> str:
    """The checkpoint folder: the session's setting; an own one where that is unset on a single machine. On a cluster
    it must be set, as no other machine could read a local folder."""
    if setting:
        return setting
    if master.split("[")[0] != "local":
        raise RuntimeError(f"{_SETTING} is not set: it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="glyphmill-")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder.

    A checkpoint carries the constraints of the plan it replaces, and those of a loop's rounds multiply; so none are
    inferred while it is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(sc.master, spark.conf.get(_SETTING, None)))
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer, as with one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
