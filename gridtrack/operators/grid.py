"""Operators on the grid table (iy, ix, lat, lon)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, to_360, to_pm180


def metrics(grid: DataFrame) -> DataFrame:
    """grid with dx, dy (metres to the neighbour in the west and in the row before; the first ones as the second) and area."""
    row, col = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    west = haversine("lat", "lon", F.lag("lat").over(row), F.lag("lon").over(row))
    before = haversine("lat", "lon", F.lag("lat").over(col), F.lag("lon").over(col))
    out = grid.withColumn("__w", west).withColumn("__b", before)
    out = out.withColumn("dx", F.coalesce("__w", F.lead("__w").over(row))).withColumn("dy", F.coalesce("__b", F.lead("__b").over(col)))
    return out.drop("__w", "__b").withColumn("area", F.col("dx") * F.col("dy"))


def spacing(with_metrics: DataFrame) -> DataFrame:
    """One row: the mean of all dx and dy together, in metres."""
    return with_metrics.agg(((F.sum("dx") + F.sum("dy")) / (2 * F.count("*"))).alias("spacing"))


def lon_convention(grid: DataFrame) -> DataFrame:
    lo, hi = F.min("lon"), F.max("lon")
    return grid.agg(F.when((lo >= -180 - 1e-6) & (hi <= 180 + 1e-6), "pm180").when((lo >= -1e-6) & (hi <= 360 + 1e-6), "0..360").otherwise("mixed").alias("convention"))


def is_regular(grid: DataFrame) -> DataFrame:
    """One row: whether lat is one value per row and lon one per column, to 1e-4."""
    rows = grid.groupBy("iy").agg((F.max("lat") - F.min("lat")).alias("d"))
    cols = grid.groupBy("ix").agg((F.max("lon") - F.min("lon")).alias("d"))
    return rows.union(cols).agg((F.max("d") <= 1e-4).alias("regular"))


def lat_direction(grid: DataFrame) -> DataFrame:
    """One row: 1 where rows go north, else -1."""
    ends = grid.agg(F.min_by("lat", F.struct("iy", "ix")).alias("x"), F.min("iy").alias("lo"), F.max("iy").alias("hi"))
    both = grid.join(F.broadcast(ends), (F.col("iy") == F.col("lo")) | (F.col("iy") == F.col("hi")))
    mean = lambda side: F.avg(F.when(F.col("iy") == F.col(side), F.col("lat")))
    return both.agg(F.when(mean("hi") > mean("lo"), 1).otherwise(-1).alias("direction"))


def is_periodic(grid: DataFrame) -> DataFrame:
    """One row: whether the columns close the circle: three at least, none twice, and no gap of 1.5 median gaps or more."""
    lons = grid.where("iy = 0").select(F.round(to_360("lon"), 6).alias("l")).agg(F.array_sort(F.collect_list("l")).alias("a"))  # one grid row
    gaps = F.transform("a", lambda x, i: F.coalesce(F.get("a", i + 1), F.get("a", F.lit(0)) + 360) - x)
    facts = lons.select(F.size("a").alias("n"), (F.size(F.array_distinct("a")) == F.size("a")).alias("single"), F.array_sort(gaps).alias("g"))
    mid = (F.get("g", F.floor((F.size("g") - 1) / 2).cast("int")) + F.get("g", F.floor(F.size("g") / 2).cast("int"))) / 2
    closed = facts.select(((F.col("n") >= 3) & F.col("single") & (F.get("g", F.size("g") - 1) < 1.5 * mid)).alias("closed"))
    return closed.crossJoin(is_regular(grid)).select((F.col("closed") & F.col("regular")).alias("periodic"))  # two single rows


def normalise(grid: DataFrame, convention: str = "pm180", lat_order: str | None = None, regular: bool = True) -> DataFrame:
    """old_iy, old_ix, iy, ix, lat, lon: longitudes wrapped; a regular grid's columns in rising longitude, and rows north or south first if asked."""
    wrapped = grid.withColumn("lon", to_pm180("lon") if convention == "pm180" else to_360("lon"))
    if not regular:
        return wrapped.select(F.col("iy").alias("old_iy"), F.col("ix").alias("old_ix"), "iy", "ix", "lat", "lon")
    cols = wrapped.where("iy = 0").select("ix", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lon")) - 1).alias("new_ix"))  # one grid row
    rows = wrapped.where("ix = 0").select("iy", "lat")
    order = {"south_first": F.col("lat").asc(), "north_first": F.col("lat").desc()}.get(lat_order, F.col("iy").asc())
    rows = rows.select("iy", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).alias("new_iy"))
    out = wrapped.join(F.broadcast(cols), "ix").join(F.broadcast(rows), "iy")
    return out.select(F.col("iy").alias("old_iy"), F.col("ix").alias("old_ix"), F.col("new_iy").alias("iy"), F.col("new_ix").alias("ix"), "lat", "lon")


def grid_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: cells in only one grid, the largest difference of lat and lon, and whether the grids are the same."""
    y = b.select("iy", "ix", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    both = a.select("iy", "ix", "lat", "lon").join(y, ["iy", "ix"], "full_outer")
    far = F.greatest(F.abs(F.col("lat") - F.col("lat2")), F.abs(F.col("lon") - F.col("lon2")))
    out = both.agg(F.count_if(F.col("lat").isNull() | F.col("lat2").isNull()).alias("unmatched"), F.coalesce(F.max(far), F.lit(0.0)).alias("largest"))
    return out.withColumn("same", (F.col("unmatched") == 0) & (F.col("largest") <= tolerance))


def summary(grid: DataFrame) -> DataFrame:
    """One row: kind, ny, nx, ranges, convention, lat order, spacing in km, periodic."""
    facts = grid.agg((F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    for one in (is_regular(grid), lon_convention(grid), lat_direction(grid), is_periodic(grid), spacing(metrics(grid))):
        facts = facts.crossJoin(one)  # single rows
    return facts.select(F.when(F.col("regular"), "regular").otherwise("curvilinear").alias("kind"), "ny", "nx", "lat_min", "lat_max", "lon_min", "lon_max", "convention", F.when(F.col("direction") > 0, "ascending").otherwise("descending").alias("lat_order"), (F.col("spacing") / 1000).alias("spacing_km"), "periodic")


def on_land(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, lat, lon) with `land`: inside a polygon of edges (poly_id, x1, y1, x2, y2), by crossings of a ray to the east."""
    lon = to_pm180("lon")
    p = points.withColumn("__x", lon)
    y, x = F.col("lat"), F.col("__x")
    spans = ((F.col("y1") <= y) & (y < F.col("y2"))) | ((F.col("y2") <= y) & (y < F.col("y1")))
    right = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) > x
    # Edges are dealt to the whole degrees of latitude that they reach over, so that the join has an equal key.
    band = edges.withColumn("__band", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    cut = p.withColumn("__band", F.floor("lat")).join(band, "__band").where(spans & right)
    inside = cut.groupBy(*keys, "poly_id").agg((F.count("*") % 2 == 1).alias("inside")).where("inside").select(*keys).distinct().withColumn("land", F.lit(True))
    return points.join(inside, keys, "left").withColumn("land", F.coalesce("land", F.lit(False)))


def land_mask(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """iy, ix, land of a grid whose rows have one latitude each: as on_land, by scan lines.

    Each row meets the edges that pass its latitude; the crossings of a polygon, in order, lead in
    and out of it by turns, and a cell is on land if more lead in than out up to its longitude. A
    row costs its crossings and its cells, not their product.
    """
    rows = grid.groupBy("iy").agg(F.first("lat").alias("lat"))
    y = F.col("lat")
    spans = ((F.col("y1") <= y) & (y < F.col("y2"))) | ((F.col("y2") <= y) & (y < F.col("y1")))
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    band = edges.withColumn("__band", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    cut = rows.withColumn("__band", F.floor("lat")).join(band, "__band").where(spans).select("iy", "poly_id", x.alias("x"))
    turn = F.when(F.row_number().over(Window.partitionBy("iy", "poly_id").orderBy("x")) % 2 == 1, 1).otherwise(-1)
    marks = cut.select("iy", F.lit(None).cast("int").alias("ix"), "x", turn.alias("turn"))
    cells = grid.select("iy", F.col("ix").cast("int").alias("ix"), to_pm180("lon").alias("x"), F.lit(0).alias("turn"))
    inside = F.sum("turn").over(Window.partitionBy("iy").orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    return marks.union(cells).withColumn("inside", inside).where("ix is not null").select("iy", "ix", (F.col("inside") > 0).alias("land"))


def axes(grid: DataFrame) -> DataFrame:
    """axis, i, value: the latitudes of the first column and the longitudes of the first row."""
    lat = grid.where("ix = 0").select(F.lit("lat").alias("axis"), F.col("iy").alias("i"), F.col("lat").alias("value"))
    return lat.union(grid.where("iy = 0").select(F.lit("lon"), "ix", "lon"))


