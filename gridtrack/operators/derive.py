"""Fields derived from fields: anomalies, gradients, the frontal diagnostic, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import coriolis
from .stencil import CELL, LINE, box_mean, box_means


def anomaly(field: DataFrame, small: float, time: float, large: float, value: str = "v", wrap_lon: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """A small box mean less a background mean (time steps, large box). shape: as in box_mean."""
    both = shape and box_means(field, {"__s": (1, small), "__b": (time, large)}, shape, value, wrap_lon)
    if both:
        return both.select(*CELL, (F.col("__s") - F.col("__b")).alias("anom"))
    background = box_mean(field, time, large, (value,), wrap_lon, shape).select(*CELL, F.col(value).alias("__b"))
    return box_mean(field, 1, small, (value,), wrap_lon, shape).join(background, list(CELL)).select(*CELL, (F.col(value) - F.col("__b")).alias("anom"))


def mask_by_label(field: DataFrame, labels: DataFrame, value: str = "v") -> DataFrame:
    """field with 0 where no object is."""
    on = labels.select(*CELL, F.lit(True).alias("__in"))
    return field.join(on, list(CELL), "left").withColumn(value, F.when(F.col("__in"), F.col(value)).otherwise(0.0)).drop("__in")


def gradient(value: str, axis: str) -> Column:
    """Central difference per index step along an axis, one-sided at the ends."""
    w = Window.partitionBy(*LINE[axis]).orderBy(axis)
    ahead, back, v = F.lead(value).over(w), F.lag(value).over(w), F.col(value)
    return F.coalesce((ahead - back) / 2, ahead - v, v - back)


def front_diagnostic(winds: DataFrame, grid: DataFrame, north: int, mask: DataFrame | None = None, abs_diag: bool = False) -> DataFrame:
    """winds: cells with u, v, temp; grid: iy, ix, lat, dx, dy. `diag` is the strength of rotation times temperature gradient (K per 100 km), over f * 0.45.

    With a mask (iy, ix, mask): its absolute value, and 0 where the mask is 0 or within 10 degrees of the equator.
    """
    rows = winds.repartition("segment", "t")
    g = {f"d{v}_{a}": gradient(v, i) for v, a, i in (("v", "x", "ix"), ("u", "y", "iy"), ("temp", "x", "ix"), ("temp", "y", "iy"))}
    rows = rows.select(*CELL, *(c.alias(k) for k, c in g.items())).join(grid.select("iy", "ix", "lat", "dx", "dy"), ["iy", "ix"])
    dx, dy = F.col("dx"), F.col("dy")
    turn = F.abs(F.col("dv_x") / dx - north * F.col("du_y") / dy)
    slope = F.sqrt(F.pow(F.col("dtemp_x") / dx, 2) + F.pow(F.col("dtemp_y") / dy, 2)) * 100_000
    rows = rows.withColumn("diag", turn * slope / (coriolis("lat") * 0.45))
    if mask is not None:
        off = (F.coalesce("mask", F.lit(0)) == 0) | (F.abs(F.col("lat")) < 10)
        rows = rows.join(mask.select("iy", "ix", "mask"), ["iy", "ix"], "left").withColumn("diag", F.when(off, 0.0).otherwise(F.abs("diag")))
    elif abs_diag:
        rows = rows.withColumn("diag", F.abs("diag"))
    return rows.select(*CELL, "diag")
