"""Materialise a DataFrame where every executor can read it; shares of a shuffle that do not grow with the input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files for each part of a table that is spread by key.
SPREAD_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and the master is local."""
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="tracelake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialized(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df hash partitioned by keys, in a part for every SPREAD_BYTES of the files behind it; the session's partitions where their size is not known.

    Shuffles of unstated size grow to 64 MB compressed, which sorts and hash tables multiply in one task's memory.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df.repartition(*keys) if size >= 1 << 60 else df.repartition(max(1, -(-size // SPREAD_BYTES)), *keys)
