"""Fields from other tables: dense from vectors, hourly from events, large from order lines; and their grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_vectors(embeddings: DataFrame, nx: int = 8) -> DataFrame:
    """Step vec_id, row k div nx, column k mod nx, value embedding[k]."""
    rows = embeddings.select(F.col("vec_id").cast("int").alias("t"), F.posexplode("embedding").alias("k", "v"))
    return rows.select(F.lit(0).alias("segment"), "t", F.floor(F.col("k") / nx).cast("int").alias("iy"), (F.col("k") % nx).cast("int").alias("ix"), F.col("v").cast("double").alias("v"))


def from_events(events: DataFrame) -> DataFrame:
    """Hourly: hours since 2024-01-01, row user_id mod 10, column (user_id div 10) mod 15, sum of values."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 3.6e9).cast("long")
    rows = events.select(hour.alias("hour_idx"), (F.col("user_id") % 10).cast("int").alias("iy"), (F.floor(F.col("user_id") / 10) % 15).cast("int").alias("ix"), F.col("value").alias("x"))
    return rows.groupBy(F.lit(0).alias("segment"), "hour_idx", "iy", "ix").agg(F.sum("x").alias("v"))


def from_lines(lineitem: DataFrame) -> DataFrame:
    """Weeks since 1995-01-01, row l_suppkey mod 40, column l_partkey mod 50, sum of what is paid."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7).cast("int")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = lineitem.select(week.alias("t"), (F.col("l_suppkey") % 40).cast("int").alias("iy"), (F.col("l_partkey") % 50).cast("int").alias("ix"), paid.alias("x"))
    return rows.groupBy(F.lit(0).alias("segment"), "t", "iy", "ix").agg(F.sum("x").alias("v"))


def regular_grid(spark: SparkSession, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """iy, ix, lat, lon from (first, step, number) of each axis: two axis tables, every pair of which is a cell."""
    y = spark.range(lat[2]).select(F.col("id").cast("int").alias("iy"), (F.lit(lat[0]) + F.col("id") * lat[1]).alias("lat"))
    x = spark.range(lon[2]).select(F.col("id").cast("int").alias("ix"), (F.lit(lon[0]) + F.col("id") * lon[1]).alias("lon"))
    return y.crossJoin(x).select("iy", "ix", "lat", "lon")  # a grid is the product of its axes
