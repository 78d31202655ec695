"""Streams side by side: tables bucketed and sorted by step, whose joins on cells need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir

STEP = ("segment", "t")


def colocated(spark: SparkSession) -> None:
    """Lets joins on cells use buckets of steps: without this setting of the session Spark asks for buckets by all join keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")


def bucketed(rows: DataFrame, buckets: int, name: str = "stream") -> DataFrame:
    """rows (segment, t, iy, ix…) as a table of that many buckets by (segment, t), one sorted file each: fields, labels and statistics that are written so meet without an exchange, in windows by step too. Tables that meet need the same number of buckets."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    order = [c for c in ("iy", "ix") if c in rows.columns]
    path = f"{shared_dir(spark)}/{table}"
    rows.repartition(buckets, *STEP).write.bucketBy(buckets, *STEP).sortBy(*STEP, *order).option("path", path).saveAsTable(table)
    return spark.table(table)
