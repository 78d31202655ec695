"""Input checks and canonicalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import convert, lookup
from ..operators.grid import is_periodic, is_regular, lat_direction, lon_convention
from ..operators.timeaxis import accumulate, file_gaps, interpolate, subsample

RANK = {"ready": 0, "prepare": 1, "unsupported": 2, "missing": 2}
OPTIONAL = {"z850.q", "z850.v", "z200.v"}


def stream_report(index: DataFrame, dt: float, precipitation: bool = False, may_interpolate: bool = False) -> DataFrame:
    """stream, files, first, last, status, notes. index: stream, path, t0, t1 (hours), step_h, calendar."""
    facts = index.groupBy("stream").agg(F.count("*").alias("files"), F.min("t0").alias("first"), F.max("t1").alias("last"), F.array_sort(F.collect_set("calendar")).alias("calendars"), F.array_sort(F.collect_set("step_h")).alias("steps"))
    gaps = file_gaps(index).groupBy("stream").agg(F.count_if(F.col("note") == "gap").alias("gaps"), F.count_if(F.col("note") == "overlap").alias("overlaps"))
    facts = facts.join(gaps, "stream", "left")
    step = F.get("steps", F.lit(0))
    even = lambda a, b: F.abs(a / b - F.round(a / b)) < 1e-8
    ratio = F.when(F.abs(step - dt) < 1e-8, "ready").when((step < dt) & even(F.lit(float(dt)), step), "accumulate" if precipitation else "subsample").when((step > dt) & even(step, F.lit(float(dt))), "interpolate" if may_interpolate and not precipitation else "unsupported").otherwise("unsupported")
    facts = facts.withColumn("fit", ratio).fillna(0, ["gaps", "overlaps"])
    several = (F.size("calendars") > 1) | (F.size("steps") > 1)
    status = F.when(several | (F.col("fit") == "unsupported"), "unsupported").when((F.col("fit") == "ready") & (F.col("gaps") == 0), "ready").otherwise("prepare")
    notes = F.array_compact(F.array(F.when(F.size("calendars") > 1, "several calendars"), F.when(F.size("steps") > 1, "several steps"), F.when(F.col("gaps") > 0, F.concat_ws(" ", F.lit("gaps:"), "gaps")), F.when(F.col("overlaps") > 0, F.concat_ws(" ", F.lit("overlaps:"), "overlaps")), F.when(F.col("fit") != "ready", F.col("fit"))))
    return facts.select("stream", "files", "first", "last", status.alias("status"), notes.alias("notes"))


def variable_report(table: DataFrame, stream: str, variables: dict[str, tuple[str, str]], dims: tuple[str, ...] = ("t", "iy", "ix"), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per canonical variable (name: source column, unit): status, conversion. Reads the schema, and of extra dimensions their sizes."""
    spark = table.sparkSession
    rows = []
    for name, (source, unit) in variables.items():
        there = source in table.columns
        rows.append((stream, name, source, unit, {"u": "wind", "v": "wind", "ivte": "ivt", "ivtn": "ivt"}.get(name, name), there, f"{stream}.{name}" in OPTIONAL))
    facts = lookup(spark.createDataFrame(rows, "stream string, variable string, source string, unit string, var_class string, present boolean, optional boolean"))
    sizes = table.agg(*(F.count_distinct(e).alias(e) for e in extra)).first().asDict() if extra else {}
    wide = [e for e, n in sizes.items() if n > 1]
    staggered = [d for d in dims if d not in table.columns]
    same = (F.col("factor") == 1.0) & (F.col("offset") == 0.0)
    status = F.when(~F.col("present"), F.when(F.col("optional"), "prepare").otherwise("missing")).when(F.lit(bool(wide or staggered)) | F.col("factor").isNull(), "unsupported").when(same & F.lit(not sizes), "ready").otherwise("prepare")
    text = F.when(F.col("factor").isNull(), "unknown unit").otherwise(F.concat_ws(" ", F.when(F.col("factor") != 1.0, F.format_string("x%s", "factor")), F.when(F.col("offset") != 0.0, F.format_string("+%s", "offset")), F.when(F.col("kind") == "rate", "(rate)")))
    return facts.select("stream", "variable", "present", status.alias("status"), text.alias("conversion"))


def grid_report(grid: DataFrame, dims: tuple[str, ...], convention: str = "pm180", lat_order: str | None = None, staggered: tuple[str, ...] = ()) -> DataFrame:
    """subject, found, wanted, status: the grid's coordinates, convention of longitudes, order of rows, kind, whether it goes around, the order of a variable's dimensions, and variables on staggered points. Only a regular grid is put in another order; longitudes of neither convention, missing coordinates and staggered variables are unsupported."""
    spark = grid.sparkSession
    row = lambda subject, found, wanted, status: spark.createDataFrame([(subject, found, wanted, status)], "subject string, found string, wanted string, status string")
    there = [c for c in ("lat", "lon") if c in grid.columns]
    told = row("coordinates", ",".join(there), "lat,lon", "ready" if len(there) == 2 else "unsupported")
    told = told.union(row("dimensions", ",".join(dims), "t,iy,ix", "ready" if dims == ("t", "iy", "ix") else "prepare"))
    for name in staggered:
        told = told.union(row(f"staggered {name}", "true", "false", "unsupported"))
    if len(there) < 2:
        return told
    facts = is_regular(grid).crossJoin(lon_convention(grid)).crossJoin(lat_direction(grid)).crossJoin(is_periodic(grid))  # single rows
    order = F.when(F.col("direction") > 0, "ascending").otherwise("descending")
    other = F.col("regular") & (order != F.lit(lat_order)) if lat_order else F.lit(False)
    turned = F.when(F.col("convention") == "mixed", "unsupported").when(F.col("regular") & (F.col("convention") != convention), "prepare").otherwise("ready")
    none = F.lit(None).cast("string")
    subjects = [
        ("convention", F.col("convention"), F.lit(convention), turned), ("lat_order", order, F.lit(lat_order), F.when(other, "prepare").otherwise("ready")),
        ("kind", F.when(F.col("regular"), "regular").otherwise("curvilinear"), none, F.lit("ready")), ("periodic", F.col("periodic").cast("string"), none, F.lit("ready")),
    ]
    listed = F.array(*(F.struct(F.lit(s).alias("subject"), f.alias("found"), w.cast("string").alias("wanted"), x.alias("status")) for s, f, w, x in subjects))
    return told.union(facts.select(F.inline(listed)))


def overall(reports: DataFrame) -> DataFrame:
    """One row: the worst status over all streams that are there. reports: stream, status."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    return reports.agg(F.max_by("status", F.struct(F.element_at(rank, F.col("status")), "status")).alias("status"))


def cross_checks(streams: DataFrame) -> DataFrame:
    """stream, same_grid, same_calendar against the first readable stream by name. streams: stream, calendar, and the digest of its grid `grid_key`."""
    first = streams.agg(F.min_by(F.struct("calendar", "grid_key"), "stream").alias("f"))
    return streams.crossJoin(F.broadcast(first)).select("stream", (F.col("grid_key") == F.col("f.grid_key")).alias("same_grid"), (F.col("calendar") == F.col("f.calendar")).alias("same_calendar"))  # one row


def grid_key(grid: DataFrame) -> DataFrame:
    """One row: a digest of the grid's coordinates to 1e-4."""
    cell = F.xxhash64("iy", "ix", F.round("lat", 4), F.round("lon", 4))
    return grid.agg(F.bit_xor(cell).alias("x"), F.count("*").alias("n")).select(F.concat_ws(":", "n", "x").alias("grid_key"))


def canonicalise(table: DataFrame, mapping: DataFrame, var_class: str, unit: str, value: str, dt: float, step_h: float, precipitation: bool = False, may_interpolate: bool = False) -> DataFrame:
    """segment, hour_idx, iy, ix, v in canonical units, order and step. mapping: old_iy, old_ix, iy, ix (from grid.normalise)."""
    rows = lookup(table.withColumns({"var_class": F.lit(var_class), "unit": F.lit(unit)}))
    if rows.limit(1).where("factor is null").count():
        raise ValueError(f"no conversion of {unit!r} for {var_class}")
    kind = rows.select("kind").first()
    rate = bool(kind and kind[0] == "rate")
    rows = convert(rows, value, "v").select("segment", "hour_idx", F.col("iy").alias("old_iy"), F.col("ix").alias("old_ix"), "v")
    rows = rows.join(mapping.select("old_iy", "old_ix", "iy", "ix"), ["old_iy", "old_ix"]).select("segment", "hour_idx", "iy", "ix", "v")
    if precipitation:
        return accumulate(rows, dt, step_h, "rate" if rate else "amount").select("segment", F.col("start").alias("hour_idx"), "iy", "ix", F.col("total").alias("v"))
    if step_h > dt:
        if not may_interpolate:
            raise ValueError(f"the step of {step_h} h is longer than {dt} h")
        return interpolate(rows, int(dt))
    return subsample(rows, dt, step_h)


