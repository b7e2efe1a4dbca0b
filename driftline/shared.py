"""Tables and paths in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="driftline-")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary folder only
    where that is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/driftline/{uuid.uuid4().hex}/{name}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which
    cuts the lineage: a lost executor costs a re-read, not a re-run."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialized`` returned, once no
    result reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._driftline_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
