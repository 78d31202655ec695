"""Year jobs: streams in, labels and their fields published by tracker and segment.

A job takes its streams at the tracking step (segment, t, iy, ix, fields), checks that they have
the first stream's grid and steps, tracks, and publishes a row for each cell with the labels
(INT, 0 for none) and the fields (float32). All segments (years) that are not there yet are one
Spark job; those that are there stay, unless force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import flux_magnitude, magnitude
from ..operators.grid import grid_differences
from ..operators.stencil import CELL
from ..sources.sinks import publish, write_statistics
from ..sources.streams import dense, missing_segments
from ..storage import staged
from . import trackers
from .config import CutOff, Jet, River, Slp, Tropical, Z500
from .trackers import Domain

Streams = dict[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """streams: what it reads, first the one whose cells are written; labels: by name, from streams, grid, domain and parameters; fields: what is written beside them."""

    streams: tuple[str, ...]
    labels: Callable[[Streams, DataFrame, Domain, object], Streams]
    fields: Callable[[Streams], DataFrame]
    params: object


def _v(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(*CELL, F.col(column).cast("double").alias("v"))


def _z500(s: Streams, grid: DataFrame, d: Domain, p: Z500) -> Streams:
    z = _v(s["z500"], "z")
    return {"cyclones": trackers.cyclones_z500(z, d, p), "anticyclones": trackers.cyclones_z500(z, d, p, high=True)}


def _slp(s: Streams, grid: DataFrame, d: Domain, p: Slp) -> Streams:
    msl = _v(s["slp"], "msl")
    return {"cyclones": trackers.cyclones_slp(msl, grid, d, p), "anticyclones": trackers.cyclones_slp(msl, grid, d, p, high=True)}


def _cut_off(s: Streams, grid: DataFrame, d: Domain, p: CutOff) -> Streams:
    z = _v(s["z500"], "z")
    cyclones = staged(trackers.cyclones_z500(z, d), "cyclones")
    return {"cutoffs": trackers.cut_off_lows(cyclones, z, _v(s["z200"], "u"), grid, d, p), "cyclones": cyclones}


def _with_rain(s: Streams) -> DataFrame:
    """The cut-off job's fields; precipitation is 0 where there is none."""
    rain = s["pr"].select(*CELL, F.col("total").alias("pr"), F.col("peak").alias("pr_peak"))
    return s["z500"].select(*CELL, "z").join(rain, list(CELL), "left").fillna(0.0, ["pr", "pr_peak"])


JOBS = {
    "z500": Job(("z500",), _z500, lambda s: s["z500"].select(*CELL, "z"), Z500()),
    "slp": Job(("slp",), _slp, lambda s: s["slp"].select(*CELL, "msl"), Slp()),
    "jet": Job(("z200",), lambda s, g, d, p: {"jets": trackers.jets(s["z200"].select(*CELL, "u", "v"), g, d, p)}, lambda s: s["z200"].select(*CELL, magnitude("u", "v").alias("speed")), Jet()),
    "ar850": Job(("z850",), lambda s, g, d, p: {"rivers": trackers.rivers_flux(s["z850"].select(*CELL, "u", "v", "q"), g, d, p)}, lambda s: s["z850"].select(*CELL, flux_magnitude("u", "v", "q").alias("flux")), River()),
    "ar_ivt": Job(("ivt",), lambda s, g, d, p: {"rivers": trackers.rivers_ivt(s["ivt"].select(*CELL, "ivte", "ivtn"), d, p)}, lambda s: s["ivt"].select(*CELL, magnitude("ivte", "ivtn").alias("ivt")), River()),
    "cutoff": Job(("z500", "z200", "pr"), _cut_off, _with_rain, CutOff()),
}


def check_streams(streams: Streams, grids: Streams | None = None) -> None:
    """An error where another stream has other steps than the first one, or (grids: by stream) another grid. Precipitation has its own steps: it is put on the first stream's."""
    first, *others = streams
    steps = lambda n: streams[n].select("segment", "t").distinct()
    for name in others:
        if grids and not grid_differences(grids[first], grids[name]).first().same:
            raise ValueError(f"{name} has another grid than {first}")
        if name == "pr":
            continue
        lone = steps(first).join(steps(name), ["segment", "t"], "left_anti").union(steps(name).join(steps(first), ["segment", "t"], "left_anti"))
        if (x := lone.first()) is not None:
            raise ValueError(f"{name} has other steps than {first}: segment {x.segment}, step {x.t}")


def run(name: str, streams: Streams, grid: DataFrame, domain: Domain, path: str, params: object = None, grids: Streams | None = None, force: bool = False) -> list[int]:
    """A job's output below path/tracker=<name>/segment=<n>; the segments that were written."""
    job = JOBS[name]
    own = {s: streams[s] for s in job.streams}
    check_streams(own, grids)
    spark = grid.sparkSession
    segments = own[job.streams[0]].select("segment").distinct()
    todo = segments if force else missing_segments(segments, spark, f"{path}/tracker={name}")
    if todo.isEmpty():
        return []
    own = {s: rows.join(F.broadcast(todo), "segment", "left_semi") for s, rows in own.items()}  # a number for each year
    out = job.fields(own)
    out = out.select(*CELL, *(F.col(c).cast("float").alias(c) for c in out.columns if c not in CELL))
    for label, objects in job.labels(own, grid, domain, params or job.params).items():
        out = dense(staged(objects, label), out, label)
    return publish(out, path, name, force, by="tracker")


def objects_of(path: str, name: str, label: str, spark) -> DataFrame:
    """The objects of a label as a job wrote them."""
    rows = spark.read.parquet(f"{path}/tracker={name}").where(F.col(label) > 0)
    return rows.select("segment", F.col(label).cast("long").alias("obj_id"), "t", "iy", "ix")


def run_tropical(streams: Streams, grid: DataFrame, domain: Domain, path: str, edges: DataFrame | None = None, params: Tropical = Tropical(), grids: Streams | None = None, force: bool = False) -> list[int]:
    """Tropical cyclones among the surface cyclones that the job "slp" wrote at the same path. streams: slp (msl), z850 (temp). Labels go to tracker=tc, tracks to tracker=tc_tracks. An error where a segment's cyclones do not lie on the pressure's cells."""
    own = {s: streams[s] for s in ("slp", "z850")}
    check_streams(own, grids)
    spark = grid.sparkSession
    cells = spark.read.parquet(f"{path}/tracker=slp").select(*CELL)
    if (x := cells.join(own["slp"].select(*CELL), list(CELL), "left_anti").union(own["slp"].select(*CELL).join(cells, list(CELL), "left_anti")).first()) is not None:
        raise ValueError(f"the cyclones of segment {x.segment} are on other cells than the pressure: track them again")
    cyclones = objects_of(path, "slp", "cyclones", spark)
    found, tracks = trackers.tropical_cyclones(cyclones, _v(own["z850"], "temp"), _v(own["slp"], "msl"), grid, domain, edges, params)
    fields = own["slp"].select(*CELL, F.col("msl").cast("float").alias("msl"))
    written = publish(dense(staged(found, "tropical"), fields, "cyclones"), path, "tc", force, by="tracker")
    write_statistics(tracks, path, "tc_tracks", force)
    return written
