"""The folder that driver and executors share, for intermediate tables and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where one machine runs all and the session names no folder (tests, the bench).
LOCAL_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a machine-local folder serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return LOCAL_DIR
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables and files that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: its partitions are fixed and its lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
