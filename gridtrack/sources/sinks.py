"""Sinks that publish whole parts: a part (stream or tracker, segment) is there as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stencil import CELL
from ..storage import file_system


def publish(rows: DataFrame, path: str, name: str, force: bool = False, by: str = "stream") -> list[int]:
    """Segments of rows written below path/<by>=<name>/segment=<n>, in order; those that are there stay as they are, unless force.

    All parts are written to a hidden folder and renamed one by one when they are complete, so a run
    that ends early leaves no half part, and the next run writes what is missing. A part that is
    replaced is put aside first: between the two renames it is missing, never half there.
    """
    spark = rows.sparkSession
    fs, home = file_system(spark, f"{path}/{by}={name}")
    at = spark._jvm.org.apache.hadoop.fs.Path
    wanted = sorted(r.segment for r in rows.select("segment").distinct().collect())  # years
    todo = [s for s in wanted if force or not fs.exists(at(home, f"segment={s}"))]
    if not todo:
        return []
    hidden = f"{path}/_part-{uuid.uuid4().hex}"
    try:
        order = [c for c in ("t", "iy", "ix", "obj_id") if c in rows.columns]
        some = rows.where(F.col("segment").isin(todo)).repartitionByRange("segment", *order[:1]).sortWithinPartitions("segment", *order)
        some.write.partitionBy("segment").parquet(hidden)
        fs.mkdirs(home)
        for s in todo:
            target = at(home, f"segment={s}")
            if fs.exists(target):
                fs.rename(target, at(f"{hidden}/_old-{s}"))
            if not fs.rename(at(f"{hidden}/segment={s}"), target):
                raise OSError(f"{target} cannot be put in place")
    finally:
        fs.delete(at(hidden), True)
    return todo


def prepare(streams: dict[str, DataFrame], path: str, force: bool = False) -> dict[str, list[int]]:
    """Canonical streams written as float32 fields on their cells; for each the segments that were written. streams: name to (segment, t, iy, ix, fields…)."""
    out = {}
    for name, rows in streams.items():
        fields = [c for c in rows.columns if c not in CELL]
        out[name] = publish(rows.select(*CELL, *(F.col(c).cast("float").alias(c) for c in fields)), path, name, force)
    return out


def write_statistics(stats: DataFrame, path: str, tracker: str, force: bool = True) -> list[int]:
    """Characteristics of objects (one row an object and step, or an object) beside a tracker's output."""
    return publish(stats, path, tracker, force, by="tracker")
