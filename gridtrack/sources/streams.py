"""Streams of fields: scans, file index, years, sinks. A stream is Parquet in folders `segment=<year>`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stencil import CELL
from ..operators.timeaxis import accumulate, align, subsample
from ..storage import staged

#: Coordinates of some archives that no operator uses.
DROPPED = ("expver", "number")
STREAMS = {"z500": ("z",), "z200": ("u", "v"), "z850": ("u", "v", "t", "q"), "slp": ("msl",), "pr": ("tp",), "ivt": ("ivte", "ivtn")}


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files of a stream as one table; FileNotFoundError names the path where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = (spark.read.option("pathGlobFilter", pattern) if pattern else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"{path} {pattern or ''}: no file") from e
        raise
    return rows.drop(*DROPPED)


def year_scan(table: DataFrame, year: int, halo_h: float = 0, ts: str = "ts") -> DataFrame:
    """The year's rows with halo_h hours on both sides; a range of stamps, which prunes row groups."""
    lo, hi = F.lit(f"{year}-01-01 00:00:00").cast("timestamp"), F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp")
    seconds = int(halo_h * 3600)
    return table.where((F.col(ts) >= lo - F.expr(f"interval {seconds} seconds")) & (F.col(ts) < hi + F.expr(f"interval {seconds} seconds")))


def file_index(table: DataFrame, ts: str = "ts", calendar: str = "standard") -> DataFrame:
    """path, mtime, size, t0, t1, n, step_h, calendar of each file; n counts stamps, step_h is their most frequent difference."""
    from pyspark.sql import Window

    meta = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col(ts).alias("ts")).distinct()
    w = Window.partitionBy("path").orderBy("ts")
    meta = meta.withColumn("d", F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 3.6e9, 6))
    return meta.groupBy("path", "mtime", "size").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"), F.mode("d").alias("step_h"), F.lit(calendar).alias("calendar"))


def stale_files(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Files of a listing that the stored index does not know as they are now."""
    return listing.join(index.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def available_years(index: DataFrame) -> DataFrame:
    """Years that any file reaches into. index: t0, t1."""
    return index.select(F.explode(F.sequence(F.year("t0"), F.year("t1"))).alias("year")).distinct().orderBy("year")


def select_years(years: DataFrame, first: int, last: int) -> DataFrame:
    return years.where(F.col("year").between(first, last))


def slice_year(table: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    """The year's rows; a range of the column's own type, which reaches the scan."""
    first, after = (F.lit(f"{y}-01-01").cast(table.schema[ts].dataType) for y in (year, year + 1))
    return table.where((F.col(ts) >= first) & (F.col(ts) < after))


def years_of_streams(**indexes: DataFrame) -> DataFrame:
    """year, streams: all years of any stream, and which streams have it, by name."""
    named = [available_years(index).withColumn("stream", F.lit(name)) for name, index in indexes.items()]
    return reduce(DataFrame.union, named).groupBy("year").agg(F.sort_array(F.collect_set("stream")).alias("streams"))


def squeeze(table: DataFrame, extra: str) -> DataFrame:
    """table without a dimension of one value; an error where it has more."""
    n = table.agg(F.count_distinct(extra)).first()[0]
    if n > 1:
        raise ValueError(f"{extra} has {n} values")
    return table.drop(extra)


def map_columns(table: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Source columns under canonical names (canonical: source); those that are missing come back as notes."""
    missing = [c for c, s in names.items() if s not in table.columns]
    kept = [c for c in (*CELL, "ts", "hour_idx") if c in table.columns]
    return table.select(*kept, *(F.col(s).alias(c) for c, s in names.items() if c not in missing)), [f"{c}: {names[c]} is missing" for c in missing]


def dense(objects: DataFrame, field: DataFrame, name: str = "obj_id") -> DataFrame:
    """Every cell of the field with its object's id as INT, 0 for none."""
    ids = objects.select(*CELL, F.col("obj_id").cast("int").alias(name))
    return field.join(ids, list(CELL), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def write_segments(rows: DataFrame, path: str, keys: tuple[str, ...] = ("segment",)) -> None:
    """One folder for each segment, with a file for each range of steps in it; only the folders of segments in rows are replaced."""
    order = [c for c in ("t", "iy", "ix") if c in rows.columns]
    rows.repartitionByRange(*keys, *order[:1]).sortWithinPartitions(*keys, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def missing_segments(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Segments that path has no folder for yet."""
    try:
        have = spark.read.parquet(path).select("segment").distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return wanted
    return wanted.join(have, "segment", "left_anti")


def compact(months: DataFrame) -> DataFrame:
    """Months of a stream as years: rows in ranges of segment and step, sorted."""
    return months.repartitionByRange("segment", "t").sortWithinPartitions("segment", "t", "iy", "ix")


def check_shape(objects: DataFrame, n_steps: int, ny: int, nx: int) -> DataFrame:
    """objects as read back, if they fit the field: an error names what does not."""
    t, y, x = objects.agg(F.max("t"), F.max("iy"), F.max("ix")).first()
    if t is not None and (t >= n_steps or y >= ny or x >= nx):
        raise ValueError(f"objects reach ({t}, {y}, {x}), the field has ({n_steps}, {ny}, {nx})")
    return objects


def load_stream(table: DataFrame, dt: float, step_h: float) -> DataFrame:
    """A stream at the tracking step: stamps on it."""
    return subsample(table, dt, step_h)


def load_precipitation(table: DataFrame, times: DataFrame, dt: float, step_h: float, kind: str) -> DataFrame:
    """Total and peak of each tracking step on the target rows, 0 where there is none. times: segment, hour_idx, iy, ix."""
    sums = staged(accumulate(table, dt, step_h, kind).withColumnRenamed("start", "hour_idx"), "precipitation")
    return align(times, sums, "total").join(align(times, sums, "peak"), ["segment", "hour_idx", "iy", "ix"])
