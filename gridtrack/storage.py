"""Staged tables: the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at := tempfile.mkdtemp(prefix="gridtrack-"))
    return at


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = at
    return out


def released(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    df._staged_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._staged_at, True)
