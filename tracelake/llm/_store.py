"""Cut lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a temporary one, which only a local master can share."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracelake-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read from there: lost executors cost no earlier stage."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def few(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast when its rows, counted here, are at most `most`."""
    return F.broadcast(df) if df.count() <= most else df


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column of a table has, in any case."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in have:
            name += "_"
        have.add(name)
        out.append(name)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
