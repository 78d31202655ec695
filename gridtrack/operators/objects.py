"""Filters and statistics of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import to_pm180
from .label import bounding_boxes, relabel
from .stencil import CELL
from .timeaxis import consecutive

OBJ = ("segment", "obj_id")


def lifetime_filter(objects: DataFrame, min_steps: int, renumber: bool = True) -> DataFrame:
    """Objects whose bounding box reaches over min_steps steps or more, renumbered in the order of their ids."""
    long = objects.groupBy(*OBJ).agg((F.max("t") - F.min("t") + 1).alias("n")).where(F.col("n") >= min_steps).select(*OBJ)
    return relabel(objects, long) if renumber else objects.join(long, list(OBJ), "left_semi")


def translate_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """links (segment, obj_id, other_id) in new ids (mapping: segment, obj_id, new_id): rows of dead objects go, dead partners become -1."""
    own = links.join(mapping, list(OBJ)).select("segment", F.col("new_id").alias("obj_id"), "other_id")
    other = mapping.select("segment", F.col("obj_id").alias("other_id"), F.col("new_id").alias("__o"))
    return own.join(other, ["segment", "other_id"], "left").select("segment", "obj_id", F.coalesce("__o", F.lit(-1).cast("long")).alias("other_id"))


def areas(objects: DataFrame, grid: DataFrame) -> DataFrame:
    """segment, obj_id, t, area in square metres. grid: iy, ix, area."""
    return objects.join(grid.select("iy", "ix", "area"), ["iy", "ix"]).groupBy(*OBJ, "t").agg(F.sum("area").alias("area"))


def sustained(steps: DataFrame, holds: str, n: int, keys: tuple[str, ...] = OBJ) -> DataFrame:
    """keys for which the condition holds in n consecutive steps or more. steps: one row for each key and step."""
    run = consecutive(steps.where(holds), keys)
    return run.groupBy(*keys, "run").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, n)).select(*keys).distinct()


def large_and_long(objects: DataFrame, grid: DataFrame, min_area: float, min_steps: int) -> DataFrame:
    """Objects of at least min_area in min_steps consecutive steps, renumbered."""
    keep = sustained(areas(objects, grid), f"area >= {min_area!r}", min_steps)
    return relabel(objects, keep)


def area_sums(objects: DataFrame, grid: DataFrame) -> DataFrame:
    return objects.join(grid.select("iy", "ix", "area"), ["iy", "ix"]).groupBy(*OBJ).agg(F.sum("area").alias("area"))


def min_total_area(objects: DataFrame, grid: DataFrame, min_area: float) -> DataFrame:
    """Objects with min_area or more in all; ids stay."""
    return objects.join(area_sums(objects, grid).where(F.col("area") >= min_area), list(OBJ), "left_semi")


def statistics(objects: DataFrame, field: DataFrame, grid: DataFrame, spacing: float, dt: float, min_steps: int = 1, value: str = "v") -> DataFrame:
    """One row per object and active step: size, min, max, mean, tot, centre of mass, lat and lon at the rounded centre, speed in km per step (and per hour).

    The centre is rounded half-even from the corner of the bounding box and kept inside it. Objects with fewer than min_steps active steps have no rows.
    """
    v = F.col(value)
    cells = objects.join(field.select(*CELL, value), list(CELL)).join(grid.select("iy", "ix", "area"), ["iy", "ix"])
    per = cells.groupBy(*OBJ, "t").agg(F.sum("area").alias("size"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("tot"), F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    active = Window.partitionBy(*OBJ)
    per = per.withColumn("__n", F.count("*").over(active)).where(F.col("__n") >= min_steps).drop("__n")
    box = bounding_boxes(objects).select(*OBJ, "iy0", "iy1", "ix0", "ix1")
    per = per.join(box, list(OBJ))
    near = lambda c, lo, hi: F.least(F.greatest((F.bround(F.col(c) - F.col(lo), 0) + F.col(lo)).cast("int"), F.col(lo)), F.col(hi))
    per = per.withColumn("iy", near("cy", "iy0", "iy1")).withColumn("ix", near("cx", "ix0", "ix1"))
    per = per.join(grid.select("iy", "ix", "lat", "lon"), ["iy", "ix"])
    order = active.orderBy("t")
    moved = F.sqrt(F.pow(F.col("cy") - F.lag("cy").over(order), 2) + F.pow(F.col("cx") - F.lag("cx").over(order), 2))
    speed = F.when(F.lag("t").over(order) == F.col("t") - 1, moved * (spacing / 1000))
    return per.withColumn("speed", speed).withColumn("speed_kmh", F.col("speed") / dt).select(*OBJ, "t", "size", "min", "max", "mean", "tot", "cy", "cx", "lat", "lon", "speed", "speed_kmh")


def argmin_cells(objects: DataFrame, field: DataFrame, nx: int, value: str = "v") -> DataFrame:
    """segment, obj_id, t, iy, ix, and the least value; the first cell in row order on ties."""
    cells = objects.join(field.select(*CELL, value), list(CELL))
    return cells.groupBy(*OBJ, "t").agg(F.min(F.struct(F.col(value), (F.col("iy") * nx + F.col("ix")).alias("c"))).alias("m")).select(*OBJ, "t", F.floor(F.col("m.c") / nx).cast("int").alias("iy"), (F.col("m.c") % nx).cast("int").alias("ix"), F.col(f"m.{value}").alias(value))


def overlaps(objects: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """segment, t, before_id, obj_id, n: cells that an object of step t - 1 shares with one of step t."""
    last = objects.select("segment", (F.col("t") + 1).alias("t"), "iy", "ix", F.col("obj_id").alias("before_id"))
    return (after or objects).join(last, list(CELL)).groupBy("segment", "t", "before_id", "obj_id").agg(F.count("*").alias("n"))


def ring_fraction(centres: DataFrame, field: DataFrame, grid: DataFrame, radius: float, half_width: float, least_rise: float, buffer: int, value: str = "v") -> DataFrame:
    """Of each centre (keys, t, iy, ix, low, and its window y0, y1, x0, x1): ring cells, and those that lie more than least_rise above low.

    The window is written out row by row, so that cells meet it by equal keys; the ring is the cells whose distance from the centre is within half_width of radius.
    """
    from ..functions.geo import haversine

    c = centres.select(*OBJ, "t", F.col("iy").alias("ciy"), F.col("ix").alias("cix"), "low", "y0", "y1", "x0", "x1")
    c = c.join(grid.select(F.col("iy").alias("ciy"), F.col("ix").alias("cix"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), ["ciy", "cix"])
    rows = c.withColumn("iy", F.explode(F.sequence(F.greatest("y0", F.col("ciy") - buffer), F.least("y1", F.col("ciy") + buffer))))
    cells = field.select(*CELL, value).join(grid.select("iy", "ix", "lat", "lon"), ["iy", "ix"])
    near = rows.join(cells, ["segment", "t", "iy"]).where(F.col("ix").between(F.greatest("x0", F.col("cix") - buffer), F.least("x1", F.col("cix") + buffer)))
    ring = near.where(F.abs(haversine("clat", "clon", "lat", "lon") - radius) <= half_width)
    return ring.groupBy(*OBJ, "t").agg(F.count("*").alias("ring"), F.count_if(F.col(value) - F.col("low") > least_rise).alias("high"))


def whole_cloud_area(rain: DataFrame, cloud: DataFrame, grid: DataFrame) -> DataFrame:
    """segment, obj_id, t, area: in the steps of each rain object, the area of whole cloud objects that share a cell with it anywhere. A pair is held against the steps that both spans have: an object of many steps that meets many short ones costs their steps, not its own for each."""
    pairs = rain.join(cloud.select(*CELL, F.col("obj_id").alias("cloud_id")), list(CELL)).select(*OBJ, "cloud_id").distinct()
    steps = rain.select(*OBJ, "t").distinct()
    per = areas(cloud, grid).withColumnRenamed("obj_id", "cloud_id")
    span = lambda rows, key, x: rows.groupBy("segment", key).agg(F.min("t").alias(f"{x}0"), F.max("t").alias(f"{x}1"))
    both = pairs.join(span(rain, "obj_id", "r"), list(OBJ)).join(span(per, "cloud_id", "c"), ["segment", "cloud_id"])
    both = both.withColumn("a", F.greatest("r0", "c0")).withColumn("b", F.least("r1", "c1")).where("a <= b").select(*OBJ, "cloud_id", F.explode(F.sequence("a", "b")).alias("t"))
    return both.join(per, ["segment", "cloud_id", "t"]).join(steps, [*OBJ, "t"]).groupBy(*OBJ, "t").agg(F.sum("area").alias("area"))


def box_minimum(rain: DataFrame, cloud: DataFrame, field: DataFrame, value: str = "v", absent: float = 999.0) -> DataFrame:
    """segment, obj_id, t, low: the least value over cloud cells inside the rain object's bounding box, at each of its steps."""
    box = bounding_boxes(rain)
    steps = rain.select(*OBJ, "t").distinct().join(box.select(*OBJ, "iy0", "iy1", "ix0", "ix1"), list(OBJ))
    rows = steps.withColumn("iy", F.explode(F.sequence("iy0", "iy1")))
    cells = cloud.select(*CELL).distinct().join(field.select(*CELL, value), list(CELL))
    low = rows.join(cells, ["segment", "t", "iy"]).where(F.col("ix").between(F.col("ix0"), F.col("ix1"))).groupBy(*OBJ, "t").agg(F.min(value).alias("low"))
    return steps.select(*OBJ, "t").join(low, [*OBJ, "t"], "left").withColumn("low", F.coalesce("low", F.lit(absent)))


def position_steps(centres: DataFrame, spacing: float) -> DataFrame:
    """centres (segment, obj_id, t, cy, cx) with the km moved since the step before."""
    w = Window.partitionBy(*OBJ).orderBy("t")
    d = F.sqrt(F.pow(F.col("cy") - F.lag("cy").over(w), 2) + F.pow(F.col("cx") - F.lag("cx").over(w), 2)) * (spacing / 1000)
    return centres.withColumn("km", F.when(F.lag("t").over(w) == F.col("t") - 1, d))


def core_means(centres: DataFrame, objects: DataFrame, field: DataFrame, nx: int | None = None, value: str = "v") -> DataFrame:
    """segment, obj_id, t, core: the mean over the 3 x 3 cells around each centre, cut to the object's bounding box. nx: columns go round."""
    box = bounding_boxes(objects).select(*OBJ, "iy0", "iy1", "ix0", "ix1")
    around = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d)
    rows = centres.join(box, list(OBJ)).withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    rows = rows.select(*OBJ, "t", (F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("__x"), "iy0", "iy1", "ix0", "ix1")
    rows = rows.where(F.col("iy").between(F.col("iy0"), F.col("iy1")) & F.col("__x").between(F.col("ix0"), F.col("ix1")))
    rows = rows.withColumn("ix", F.pmod("__x", F.lit(nx)) if nx else F.col("__x"))
    return rows.join(field.select(*CELL, value), list(CELL)).groupBy(*OBJ, "t").agg(F.avg(value).alias("core"))


def poleward_column(centres: DataFrame, field: DataFrame, north: int, value: str = "v") -> DataFrame:
    """segment, obj_id, t, n, least: the field's cells in each centre's column, on the poleward side, inside its window (y0, y1). centres also have lat."""
    toward = F.when(F.col("lat") >= 0, north).otherwise(-north)
    lo = F.when(toward > 0, F.col("iy") + 1).otherwise(F.col("y0"))
    hi = F.when(toward > 0, F.col("y1")).otherwise(F.col("iy") - 1)
    rows = centres.select(*OBJ, "t", "ix", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").withColumn("iy", F.explode(F.sequence("lo", "hi")))
    return rows.join(field.select(*CELL, value), list(CELL)).groupBy(*OBJ, "t").agg(F.count("*").alias("n"), F.min(value).alias("least"))


def wrapped_between(lon: str, lo: float, hi: float):
    return to_pm180(lon).between(lo, hi)
