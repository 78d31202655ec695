"""The trackers: fields in, object tables out.

`field` has segment, t, iy, ix and values; `grid` has iy, ix, lat, lon, dx, dy, area. `Domain`
holds the numbers of the grid that window sizes and thresholds are worked out from. The grid
is joined by cell; whether it is broadcast is left to its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import GRAVITY, flux_magnitude, geopotential_height, magnitude, steps, to_hpa, to_pm180
from ..operators import derive, forest, label, objects, split, watershed
from ..operators.grid import on_land
from ..operators.objects import OBJ
from ..operators.stencil import CELL, gaussian, gaussian_series
from ..operators.timeaxis import consecutive
from ..storage import staged
from .config import CutOff, Front, Jet, Mcs, River, Slp, Tropical, Z500


@dataclass(frozen=True)
class Domain:
    ny: int
    nx: int
    spacing: float  # metres
    dt: float = 6.0
    periodic: bool = False
    north: int = -1  # 1: rows go north

    def cells(self, km: float) -> float:
        return km * 1000 / self.spacing


def _anomaly(field: DataFrame, d: Domain, small_km: float, hours: float, large_km: float, sigma: float | None = None) -> DataFrame:
    if sigma is not None:
        background = derive.box_mean(field, hours / d.dt, d.cells(large_km), shape=(d.ny, d.nx)).select(*CELL, F.col("v").alias("__b"))
        return gaussian(field, sigma).join(background, list(CELL)).select(*CELL, (F.col("v") - F.col("__b")).alias("anom"))
    return derive.anomaly(field, d.cells(small_km), hours / d.dt, d.cells(large_km), shape=(d.ny, d.nx))


def _objects(cells: DataFrame, d: Domain) -> DataFrame:
    return staged(label.label(cells, d.ny, d.nx), "objects")


def cyclones_z500(z: DataFrame, d: Domain, p: Z500 = Z500(), high: bool = False) -> DataFrame:
    """Upper-level cyclones, or anticyclones. z: geopotential `v`."""
    height = z.select(*CELL, geopotential_height("v").alias("v"))
    anom = _anomaly(height, d, p.small_km, p.background_h, p.background_km, p.gaussian_sigma)
    found = _objects(anom.where(F.col("anom") > p.anticyclone if high else F.col("anom") < p.cyclone), d)
    if d.periodic:
        found = label.seam_merge(found, d.nx)
    n = steps(p.life_h, d.dt)
    return forest.break_up(objects.lifetime_filter(found, n), d.ny, d.nx, n)


def cyclones_slp(msl: DataFrame, grid: DataFrame, d: Domain, p: Slp = Slp(), high: bool = False) -> DataFrame:
    """Surface cyclones, or anticyclones. msl: pressure in Pa as `v`."""
    anom = staged(_anomaly(msl.select(*CELL, to_hpa("v").alias("v")), d, p.small_km, p.background_h, p.background_km), "anomaly")
    n = steps(p.life_h, d.dt)
    found = objects.lifetime_filter(_objects(anom.where(F.col("anom") > p.anticyclone if high else F.col("anom") < p.cyclone), d), n)
    if p.watershed:
        window = int(d.cells(p.window_km)) * 2
        found = watershed.watershed_tracks(anom, staged(found, "objects"), grid, d.ny, d.nx, int(d.cells(p.peak_km)), p.peak_threshold, p.window_h / d.dt, window, n, 1 if high else -1, p.claim)
    else:
        found = forest.break_up(found, d.ny, d.nx, n)
    return label.seam_merge(found, d.nx) if d.periodic else found


def jets(winds: DataFrame, grid: DataFrame, d: Domain, p: Jet = Jet()) -> DataFrame:
    """Jet streams. winds: u and v."""
    anom = staged(_anomaly(winds.select(*CELL, magnitude("u", "v").alias("v")), d, p.small_km, p.background_h, p.background_km), "anomaly")
    n = steps(p.life_h, d.dt)
    found = objects.lifetime_filter(_objects(anom.where(F.col("anom") >= p.speed), d), n)
    if p.watershed:
        window = int(d.cells(p.window_km)) * 2
        found = watershed.watershed_tracks(anom, staged(found, "objects"), grid, d.ny, d.nx, int(d.cells(p.peak_km)), 1.0, p.window_h / d.dt, window, n)
    else:
        found = forest.break_up(found, d.ny, d.nx, n)
    return label.seam_merge(found, d.nx, per_step=True) if d.periodic else found


def rivers_flux(field: DataFrame, grid: DataFrame, d: Domain, p: River = River()) -> DataFrame:
    """Atmospheric rivers by moisture flux. field: u, v, q."""
    flux = field.select(*CELL, flux_magnitude("u", "v", "q").alias("v"))
    found = _objects(flux.where(F.col("v") > p.flux), d)
    found = objects.large_and_long(found, grid, p.area_km2 * 1e6, max(1, steps(p.life_h, d.dt)))
    found = forest.break_up(found, d.ny, d.nx, 0)
    return label.seam_merge(found, d.nx, per_step=True) if d.periodic else found


def rivers_ivt(field: DataFrame, d: Domain, p: River = River()) -> DataFrame:
    """Atmospheric rivers by integrated transport. field: ivte, ivtn."""
    n = steps(p.life_h, d.dt)
    found = _objects(field.select(*CELL, magnitude("ivte", "ivtn").alias("v")).where(F.col("v") > p.ivt), d)
    found = forest.break_up(objects.lifetime_filter(found, n), d.ny, d.nx, n)
    return label.seam_merge(found, d.nx, per_step=True) if d.periodic else found


def fronts(field: DataFrame, grid: DataFrame, d: Domain, p: Front = Front(), mask: DataFrame | None = None, abs_diag: bool = False) -> DataFrame:
    """Fronts: objects of single steps; ids stay. field: u, v, temp."""
    diag = derive.front_diagnostic(field, grid, d.north, mask, abs_diag)
    found = label.label(diag.where(F.col("diag") > p.diag), d.ny, d.nx, through_time=False)
    return objects.min_total_area(found, grid, p.area_km2 * 1e6)


def cut_off_centres(cyclones: DataFrame, z: DataFrame, u200: DataFrame, grid: DataFrame, d: Domain, p: CutOff = CutOff()) -> DataFrame:
    """segment, obj_id, t, iy, ix, low and `ok`: each cyclone's centre and whether its step passes all rules of a cut-off low. cyclones: already split."""
    b = int(d.cells(p.buffer_km))
    box = label.bounding_boxes(cyclones)
    long = box.where((F.col("t1") - F.col("t0") + 1) * d.dt >= p.life_h)
    window = long.select(*OBJ, F.greatest(F.col("iy0") - b, F.lit(0)).alias("y0"), F.least(F.col("iy1") + b, F.lit(d.ny - 1)).alias("y1"), F.greatest(F.col("ix0") - b, F.lit(0)).alias("x0"), F.least(F.col("ix1") + b, F.lit(d.nx - 1)).alias("x1"))
    centre = objects.argmin_cells(cyclones, z, d.nx).withColumnRenamed("v", "low").join(window, list(OBJ))
    centre = staged(centre.join(grid.select("iy", "ix", "lat", "lon"), ["iy", "ix"]), "centres")
    ring = objects.ring_fraction(centre, z, grid, p.ring_km * 1000, 2 * d.spacing, p.ring_rise * GRAVITY, b)
    reached = centre.withColumn("y0", F.greatest("y0", F.col("iy") - b)).withColumn("y1", F.least("y1", F.col("iy") + b))
    poleward = objects.poleward_column(reached, u200, d.north)
    cells = cyclones.join(grid.select("iy", "ix", "lat", "lon"), ["iy", "ix"])
    own = cells.join(centre.select(*OBJ, "t", F.col("iy").alias("cy"), F.col("ix").alias("cx"), "y0", "y1", "x0", "x1"), [*OBJ, "t"])
    near = (F.abs(F.col("iy") - F.col("cy")) <= b) & (F.abs(F.col("ix") - F.col("cx")) <= b)
    outside = ~(F.col("lat").between(*p.lat) & to_pm180("lon").between(*p.lon))
    border = (F.col("iy") == 0) | (F.col("iy") == d.ny - 1) | (F.col("ix") == 0) | (F.col("ix") == d.nx - 1)
    mid = lambda c, lo: (F.bround(F.avg(c) - F.first(lo), 0) + F.first(lo)).cast("int")
    shape = own.groupBy(*OBJ, "t").agg(F.count_if(near & outside).alias("stray"), F.count_if(border).alias("border"), mid("iy", "y0").alias("my"), mid("ix", "x0").alias("mx"))
    at = grid.select(F.col("iy").alias("my"), F.col("ix").alias("mx"), F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    rows = grid.groupBy("iy").agg(F.max(F.abs("lat")).alias("far")).withColumnRenamed("iy", "wy")
    reach = centre.select(*OBJ, "t", F.explode(F.sequence(F.greatest("y0", F.col("iy") - b), F.least("y1", F.col("iy") + b))).alias("wy")).join(rows, "wy").groupBy(*OBJ, "t").agg(F.max("far").alias("far"))
    all_ = centre.join(ring, [*OBJ, "t"], "left").join(poleward, [*OBJ, "t"], "left").join(shape, [*OBJ, "t"]).join(at, ["my", "mx"]).join(reach, [*OBJ, "t"])
    ok = (
        F.abs("lat").between(*p.centre_lat) & (F.col("far") <= p.pole) & (F.col("stray") == 0) & (F.coalesce("high", F.lit(0)) >= p.ring_share * F.coalesce("ring", F.lit(0)))
        & (F.coalesce("n", F.lit(0)) > 0) & (F.col("least") <= 0) & (F.col("low") / GRAVITY <= p.height)
        & to_pm180("mlon").between(p.region[0], p.region[1]) & F.col("mlat").between(p.region[2], p.region[3]) & (F.col("border") == 0)
    )
    return all_.select(*OBJ, "t", "iy", "ix", "low", F.coalesce(ok, F.lit(False)).alias("ok"))


def cut_off_lows(cyclones: DataFrame, z: DataFrame, u200: DataFrame, grid: DataFrame, d: Domain, p: CutOff = CutOff()) -> DataFrame:
    """Cut-off lows: the accepted steps of z500 cyclones that are accepted over a long enough span."""
    apart = staged(split.split_objects(cyclones, d.ny, d.nx, int(d.cells(p.split_km))), "apart")
    good = staged(cut_off_centres(apart, z, u200, grid, d, p).where("ok").select(*OBJ, "t"), "accepted")
    span = good.groupBy(*OBJ).agg((F.max("t") - F.min("t") + 1).alias("n")).where(F.col("n") * d.dt >= p.life_h).select(*OBJ)
    return apart.join(good.join(span, list(OBJ), "left_semi"), [*OBJ, "t"], "left_semi")


def mcs(pr: DataFrame, bt: DataFrame, grid: DataFrame, d: Domain, p: Mcs = Mcs()) -> tuple[DataFrame, DataFrame]:
    """Mesoscale convective systems: (statistics of the merged systems, labels that keep the rain objects' ids). pr: mm per step; bt: K."""

    def detected(field: DataFrame, cells: DataFrame, km2: float, hours: float) -> DataFrame:
        found = _objects(cells, d)
        found = label.seam_merge(found, d.nx) if d.periodic else found
        return staged(objects.large_and_long(found, grid, km2 * 1e6, max(1, steps(hours, d.dt))), "systems")

    wet, cold = gaussian(pr, p.sigma_pr), gaussian(bt, p.sigma_bt)
    rain = detected(pr, wet.where(F.col("v") >= p.pr * d.dt), p.pr_km2, p.pr_h)
    cloud = detected(bt, cold.where(F.col("v") <= p.bt), p.bt_km2, p.bt_h)
    hit = mcs_steps(rain, cloud, pr, bt, grid, d, p)
    keep = objects.sustained(hit, "hit", max(1, steps(p.life_h, d.dt)))
    systems = staged(rain.join(keep, list(OBJ), "left_semi"), "mcs")
    merged = label.label(systems, d.ny, d.nx)
    return objects.statistics(merged, pr, grid, d.spacing, d.dt), systems


def mcs_steps(rain: DataFrame, cloud: DataFrame, pr: DataFrame, bt: DataFrame, grid: DataFrame, d: Domain, p: Mcs = Mcs()) -> DataFrame:
    """segment, obj_id, t, hit: whether a rain object's step meets all criteria of an MCS."""
    area = objects.areas(rain, grid).withColumnRenamed("area", "rain_area")
    top = rain.join(pr.select(*CELL, "v"), list(CELL)).groupBy(*OBJ, "t").agg(F.max("v").alias("peak"))
    clouds = objects.whole_cloud_area(rain, cloud, grid).withColumnRenamed("area", "cloud_area")
    rows = area.join(top, [*OBJ, "t"]).join(clouds, [*OBJ, "t"], "left").join(objects.box_minimum(rain, cloud, bt), [*OBJ, "t"])
    own = Window.partitionBy(*OBJ)
    rows = rows.withColumn("best", F.max("peak").over(own)).withColumn("n", F.count("*").over(own))
    hit = (F.coalesce("cloud_area", F.lit(0.0)) >= p.cloud_km2 * 1e6) & (F.col("low") <= p.low_bt) & (F.col("rain_area") >= p.rain_km2 * 1e6) & (F.col("peak") >= p.pr * d.dt) & (F.col("best") >= p.peak * d.dt) & (F.col("n") >= 2)
    return rows.select(*OBJ, "t", hit.alias("hit"))


def tropical_cyclones(cyclones: DataFrame, t850: DataFrame, msl: DataFrame, grid: DataFrame, d: Domain, edges: DataFrame | None = None, p: Tropical = Tropical()) -> tuple[DataFrame, DataFrame]:
    """Tropical cyclones among surface cyclones: (labels with the cyclones' ids, track with null gaps). t850 in K, msl in Pa, both `v`; edges: land polygons."""
    box = label.bounding_boxes(cyclones).where(F.col("t1") - F.col("t0") + 1 >= steps(p.life_h, d.dt)).select(*OBJ, "t0", "t1")
    long = cyclones.join(box.select(*OBJ), list(OBJ), "left_semi")
    centre = objects.argmin_cells(long, msl.select(*CELL, to_hpa("v").alias("v")), d.nx).withColumnRenamed("v", "low")
    core = objects.core_means(centre, long, t850, d.nx if d.periodic else None)
    mean = long.join(t850.select(*CELL, "v"), list(CELL)).groupBy(*OBJ, "t").agg(F.avg("v").alias("mean"))
    steps_ = box.select(*OBJ, F.explode(F.sequence("t0", "t1")).alias("t"))
    rows = steps_.join(centre, [*OBJ, "t"], "left").join(core, [*OBJ, "t"], "left").join(mean, [*OBJ, "t"], "left").join(grid.select("iy", "ix", "lat", "lon"), ["iy", "ix"], "left")
    rows = gaussian_series(rows.withColumn("delta", F.col("core") - F.col("mean")), OBJ, "delta", "smooth")
    rows = staged(rows.withColumn("warm", F.coalesce(F.col("smooth") > p.warm, F.lit(False))), "tc")
    own = Window.partitionBy(*OBJ)
    rows = rows.withColumn("lat0", F.min(F.abs("lat")).over(own)).withColumn("n_warm", F.count_if(F.col("warm")).over(own)).withColumn("n_deep", F.count_if(F.col("low") < p.pressure).over(own))
    n = steps(p.keep_h, d.dt)
    rows = rows.where((F.col("lat0") <= p.genesis_lat) & (F.col("n_warm") >= n) & (F.col("n_deep") >= n))
    good = rows.where(F.col("warm") & (F.col("core") > p.core) & (F.col("low") < p.pressure) & (F.abs("lat") <= p.max_lat)).select(*OBJ, "t", "lat", "lon")
    good = staged(consecutive(good, OBJ), "tc-steps")
    if edges is not None:
        first = good.groupBy(*OBJ, "run").agg(F.min_by(F.struct("lat", "lon"), "t").alias("p")).select(*OBJ, "run", "p.lat", "p.lon")
        born = on_land(first, edges, [*OBJ, "run"]).where("land").select(*OBJ, "run")
        good = good.join(born, [*OBJ, "run"], "left_anti")
    spans = good.groupBy(*OBJ).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(*OBJ, F.explode(F.sequence("a", "b")).alias("t"))
    tracks = spans.join(good.select(*OBJ, "t", "lat", "lon"), [*OBJ, "t"], "left")
    return cyclones.join(good.select(*OBJ, "t"), [*OBJ, "t"], "left_semi"), tracks


