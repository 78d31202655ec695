"""A kept index of a stream's files: what times each file holds, in a table that is brought up to date from listings.

The table lies in folders `v=<number>`; a new version is written beside the others and renamed
into place, and readers take the highest. Only files that are new or changed are read.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system
from .streams import DROPPED, available_years, file_index, year_scan

KEYS = ("path", "mtime", "size")


def listing(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """path, mtime, size of the files below path; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(*(F.col(f"_metadata.file_{c}").alias(k) for k, c in zip(KEYS, ("path", "modification_time", "size"))))


def _versions(spark: SparkSession, at: str) -> list[int]:
    fs, root = file_system(spark, at)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def read_index(spark: SparkSession, at: str) -> DataFrame | None:
    """The index kept at a folder, or None."""
    have = _versions(spark, at)
    return spark.read.parquet(f"{at}/v={have[-1]}") if have else None


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*(unquote(p) for p in paths)).drop(*DROPPED)


def refresh(spark: SparkSession, at: str, files: DataFrame, ts: str = "ts", calendar: str = "standard", reindex: bool = False) -> tuple[DataFrame, list[str]]:
    """The index of the listed files, kept at a folder, and the files that were read for it: those that the kept index does not know as they are (all with reindex). Files that are no longer listed go from it. Without a change nothing is written."""
    known = None if reindex else read_index(spark, at)
    new = files if known is None else files.join(known.select(*KEYS), list(KEYS), "left_anti")
    paths = sorted(r.path for r in new.select("path").collect())  # names of new files
    kept = None if known is None else known.join(files.select(*KEYS), list(KEYS), "left_semi")
    if known is not None and not paths and kept.count() == known.count():
        return known, []
    parts = [] if kept is None else [kept]
    if paths:
        parts.append(file_index(read_files(spark, paths), ts, calendar))
    if not parts:
        raise FileNotFoundError("no file to index")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    have = _versions(spark, at)
    fs, root = file_system(spark, at)
    path = spark._jvm.org.apache.hadoop.fs.Path
    rows.write.parquet(temporary := f"{at}/_new-{uuid.uuid4().hex}")
    number = have[-1] + 1 if have else 1
    if not fs.rename(path(temporary), path(f"{at}/v={number}")):
        raise OSError(f"{at}/v={number} is already there")
    for old in have[:-1]:  # the last one stays for who is reading it
        fs.delete(path(f"{at}/v={old}"), True)
    return read_index(spark, at), paths


def year_files(index: DataFrame, year: int, halo_h: float = 0) -> list[str]:
    """Files that overlap the year with halo_h hours on both sides."""
    lo, hi = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp") for y in (year, year + 1))
    around = F.expr(f"interval {int(halo_h * 3600)} seconds")
    return sorted(r.path for r in index.where((F.col("t1") >= lo - around) & (F.col("t0") < hi + around)).select("path").collect())


def open_year(spark: SparkSession, index: DataFrame, year: int, halo_h: float = 0, ts: str = "ts") -> DataFrame:
    """The year's rows with halo_h hours on both sides, from only the files that overlap them; FileNotFoundError names the years that there are."""
    paths = year_files(index, year, halo_h)
    if not paths:
        years = [r.year for r in available_years(index).collect()]
        raise FileNotFoundError(f"no file with {year}; there are {years[0]} to {years[-1]}" if years else "no file in the index")
    return year_scan(read_files(spark, paths), year, halo_h, ts)
