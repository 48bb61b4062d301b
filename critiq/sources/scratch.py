"""Intermediate tables and files of an application: one folder below `spark.checkpoint.dir`, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where it is unset, a temporary one, in local mode only:
    on a cluster every executor would write to its own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="critiq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The one folder of this application's saved tables and files; drop_saved() removes it."""
    return f"{shared_dir(spark)}/critiq-{spark.sparkContext.applicationId}"


def drop_saved(spark: SparkSession) -> None:
    """Remove all that was written below run_dir() in this application. What was read from there can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below run_dir()."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder (in a folder per value of the columns `by`) and read back: lineage ends there and survives a lost executor."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
