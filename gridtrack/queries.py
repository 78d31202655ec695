"""Registered queries on the dense field of the vectors and on the grid that goes with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendars, geo, units
from .operators import derive, forest, grid, label, objects, split, stencil, timeaxis
from .operators.objects import OBJ
from .operators.stencil import CELL
from .plans import trackers
from .plans.config import Front, Jet, River, Slp, Z500
from .registry import FIELD, GRID, METRICS, TABLE_GRID, box, break_up, components, haversine, lifetime, query
from .sources import fields
from .storage import staged

NY = NX = 8
DOMAIN = trackers.Domain(NY, NX, 50_000.0)
THRESHOLD = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.from_vectors(table(spark, sf_dir, "embeddings"), NX)


def plain_grid(spark: SparkSession) -> DataFrame:
    return fields.regular_grid(spark, (75.0, -0.5, NY), (-30.0, 0.5, NX))


def full_grid(spark: SparkSession) -> DataFrame:
    return grid.metrics(plain_grid(spark))


def found(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return staged(label.label(dense(spark, sf_dir).where(F.col("v") > threshold), NY, NX), "objects")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


CELLS = "c as (select * from f where v > 0.2)"
WITH = f"with recursive {FIELD}, {CELLS}, {components('c', 'l')}"

# ---- C: grid and geography


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with a row for each customer and a column for each nation."""
    lat = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).cast("int").alias("iy"), (75.3 - 0.0001 * F.col("c_custkey")).alias("lat"))
    lon = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ix"), (-30 + 0.5 * F.col("n_nationkey")).alias("lon"))
    return lat.crossJoin(F.broadcast(lon)).select("iy", "ix", "lat", "lon")  # 25 columns


@query(f"with {TABLE_GRID} select iy, ix, round({haversine('lat', 'lon', '50.0::double', '0.0::double')}, 3) as metres from g")
def haversine_distance(spark, sf_dir):
    return table_grid(spark, sf_dir).select("iy", "ix", F.round(geo.haversine("lat", "lon", 50.0, 0.0), 3).alias("metres"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid cells that the field has values in."""
    return dense(spark, sf_dir).select("iy", "ix").distinct()


def used_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_grid(spark).join(used(spark, sf_dir), ["iy", "ix"])


@query(f"with {TABLE_GRID}, {METRICS} select iy, ix, round(dx, 3) as dx, round(dy, 3) as dy, round(area, 0) as area from ga")
def grid_metrics(spark, sf_dir):
    return rounded(grid.metrics(table_grid(spark, sf_dir)).select("iy", "ix", "dx", "dy", F.round("area", 0).alias("area")), "dx", "dy", places=3)


@query(f"with {TABLE_GRID}, {METRICS} select round((sum(dx) + sum(dy)) / (2 * count(*)), 3) as spacing from ga")
def grid_spacing(spark, sf_dir):
    return rounded(grid.spacing(grid.metrics(table_grid(spark, sf_dir))), "spacing", places=3)


@query("""select c_custkey, round((((c_custkey % 720 - 360)::double + 180) % 360 + 360) % 360 - 180, 6) as pm180, round(((c_custkey % 720 - 360)::double % 360 + 360) % 360, 6) as full_circle from customer""")
def lon_wrap(spark, sf_dir):
    lon = (F.col("c_custkey") % 720 - 360).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(geo.to_pm180(lon), 6).alias("pm180"), F.round(geo.to_360(lon), 6).alias("full_circle"))


@query(f"""with {TABLE_GRID} select case when min(lon) >= -180 and max(lon) <= 180 then 'pm180' when min(lon) >= 0 and max(lon) <= 360 then '0..360' else 'mixed' end as convention from g
    union all select case when min(lon + 360) >= -180 and max(lon + 360) <= 180 then 'pm180' when min(lon + 360) >= 0 and max(lon + 360) <= 360 then '0..360' else 'mixed' end from g""")
def lon_convention(spark, sf_dir):
    g = table_grid(spark, sf_dir)
    return grid.lon_convention(g).union(grid.lon_convention(g.withColumn("lon", F.col("lon") + 360)))


_GAPS_OF = """, q as (select k, coalesce(lead(l) over w, min(l) over (partition by k) + 360) - l as gap from l window w as (partition by k order by l))
    select k, count(*) >= 3 and min(gap) > 0 and max(gap) < 1.5 * median(gap) as periodic from q group by k"""


@query(f"with {GRID}, l as (select distinct s as k, ix * s::double as l from g, (select distinct n_regionkey * 15 as s from nation where n_regionkey > 0) n) {_GAPS_OF}")
def periodic_grid(spark, sf_dir):
    """Eight columns at four distances, of which one goes around."""
    steps_ = sorted(r.n_regionkey * 15 for r in table(spark, sf_dir, "nation").select("n_regionkey").distinct().where("n_regionkey > 0").collect())  # four
    grids = [grid.is_periodic(used_grid(spark, sf_dir).withColumn("lon", F.col("ix") * float(s))).select(F.lit(s).cast("long").alias("k"), "periodic") for s in steps_]
    return reduce(lambda a, b: a.union(b), grids)


@query(f"""with {GRID}, s as (select iy, ix, lat, case when ix < 4 then 356 + ix else ix - 4 end::double as lon from g),
    w as (select *, (lon + 180) % 360 - 180 as l from s)
    select iy as old_iy, ix as old_ix, (dense_rank() over (order by lat) - 1)::int as iy, (dense_rank() over (order by l) - 1)::int as ix, lat, l as lon from w""")
def normalise_grid(spark, sf_dir):
    s = used_grid(spark, sf_dir).withColumn("lon", F.when(F.col("ix") < 4, 356.0 + F.col("ix")).otherwise(F.col("ix") - 4.0))
    return grid.normalise(s, "pm180", "south_first")


_PAIRS = """a as (select c_custkey::int as iy, n_nationkey::int as ix, 60 - 0.001::double * c_custkey as lat, -30 + 0.5::double * n_nationkey as lon from customer, nation), s as (select s_suppkey from supplier),
    b as (select a.iy, a.ix, a.lat + 0.0001 * (a.iy % 7) as lat, a.lon from a where iy in (select s_suppkey from s)),
    d as (select greatest(abs(a.lat - b.lat), abs(a.lon - b.lon)) as d, a.iy is null or b.iy is null as lone from a full join b using (iy, ix)),
    e as (select greatest(abs(a.lat - c.lat), abs(a.lon - c.lon)) as d, a.iy is null or c.iy is null as lone from a full join a c using (iy, ix))"""


@query(f"""with {_PAIRS} select 'other' as pair, count(*) filter (where lone) as unmatched, round(max(d), 6) as largest, not bool_or(lone) and max(d) <= 1e-4 as same from d
    union all select 'itself', count(*) filter (where lone), round(max(d), 6), not bool_or(lone) and max(d) <= 1e-4 from e""")
def same_grid(spark, sf_dir):
    """A grid with a row for each customer against itself and against the rows that are suppliers too, shifted here and there."""
    lon = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ix"), (-30 + 0.5 * F.col("n_nationkey")).alias("lon"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("iy"), (60 - 0.001 * F.col("c_custkey")).alias("lat")).crossJoin(F.broadcast(lon))  # 25 columns
    b = a.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("iy")), "iy", "left_semi").withColumn("lat", F.col("lat") + 0.0001 * (F.col("iy") % 7))
    rows = [grid.grid_differences(a, other).withColumn("pair", F.lit(name)) for name, other in (("other", b), ("itself", a))]
    return rounded(rows[0].union(rows[1]).select("pair", "unmatched", "largest", "same"), "largest")


@query(f"""with {TABLE_GRID}, {METRICS} select case when (select max(d) from (select max(lat) - min(lat) as d from g group by iy union all select max(lon) - min(lon) from g group by ix)) <= 1e-4 then 'regular' else 'curvilinear' end as kind, max(iy) + 1 as ny, max(ix) + 1 as nx, min(lat) as lat_min, max(lat) as lat_max, min(lon) as lon_min, max(lon) as lon_max,
    case when min(lon) >= -180 and max(lon) <= 180 then 'pm180' when min(lon) >= 0 and max(lon) <= 360 then '0..360' else 'mixed' end as convention, case when arg_max(lat, iy) > arg_min(lat, iy) then 'ascending' else 'descending' end as lat_order,
    round((sum(dx) + sum(dy)) / (2 * count(*)) / 1000, 6) as spacing_km, (select count(*) >= 3 and max(gap) < 1.5 * median(gap) from (select coalesce(lead(l) over (order by l), min(l) over () + 360) - l as gap from (select distinct (lon + 360) % 360 as l from g))) as periodic from ga""")
def grid_summary(spark, sf_dir):
    return rounded(grid.summary(table_grid(spark, sf_dir)), "spacing_km")


@query(f"with {TABLE_GRID} select iy, ix, round(2 * 7.292115e-5 * sin(radians(lat)) * 1e6, 6) as f_micro from g")
def coriolis_parameter(spark, sf_dir):
    return table_grid(spark, sf_dir).select("iy", "ix", F.round(geo.coriolis("lat") * 1e6, 6).alias("f_micro"))


@query(f"with {TABLE_GRID} select distinct 'lat' as axis, iy as i, lat as value from g union all select distinct 'lon', ix, lon from g")
def grid_axes(spark, sf_dir):
    return grid.axes(table_grid(spark, sf_dir))


LAND = [(1, -30.1, 74.9, -28.4, 75.2), (1, -28.4, 75.2, -28.1, 72.3), (1, -28.1, 72.3, -30.2, 72.4), (1, -30.2, 72.4, -30.1, 74.9), (2, -27.2, 73.2, -26.3, 73.3), (2, -26.3, 73.3, -26.4, 71.2), (2, -26.4, 71.2, -27.2, 73.2)]


#: Corners as doubles: bare numbers would be decimals, whose differences and quotients are other numbers than the query's.
_EDGES = f"e(poly, x1, y1, x2, y2) as (values {', '.join(str((p, *(f'{c}::double' for c in xy))).replace(chr(39), '') for p, *xy in LAND)})"
_ROWS = "gr as (select c_custkey::int as iy, n_nationkey::int as ix, 75.3::double - 0.0001::double * ((c_custkey * 7919) % 40000) as lat, -30.4::double + 0.18::double * n_nationkey as lon from customer, nation)"


def _scattered_rows(spark, sf_dir):
    """A grid of a row for each customer and a column for each nation, the rows in no order."""
    lat = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("iy"), (75.3 - 0.0001 * ((F.col("c_custkey") * 7919) % 40000)).alias("lat"))
    lon = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ix"), (-30.4 + 0.18 * F.col("n_nationkey")).alias("lon"))
    return lat.crossJoin(F.broadcast(lon))  # 25 columns


@query(f"""with {_ROWS}, {_EDGES},
    x as (select iy, ix, poly, count(*) as n from gr join e on ((y1 <= lat and lat < y2) or (y2 <= lat and lat < y1)) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon group by all)
    select gr.iy, gr.ix, exists (select 1 from x where x.iy = gr.iy and x.ix = gr.ix and n % 2 = 1) as land from gr""")
def point_on_land(spark, sf_dir):
    edges = spark.createDataFrame(LAND, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    return grid.on_land(_scattered_rows(spark, sf_dir), edges, ["iy", "ix"]).select("iy", "ix", "land")


@query(f"""with {_ROWS}, {_EDGES},
    x as (select iy, ix, poly, count(*) as n from gr join e on ((y1 <= lat and lat < y2) or (y2 <= lat and lat < y1)) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon group by all)
    select gr.iy, gr.ix, exists (select 1 from x where x.iy = gr.iy and x.ix = gr.ix and n % 2 = 1) as land from gr""")
def land_mask(spark, sf_dir):
    edges = spark.createDataFrame(LAND, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    return grid.land_mask(_scattered_rows(spark, sf_dir), edges)


# ---- D: units, derived fields


UNIT_NAMES = ("hPa", "m**2 s**-2", "degC", "g kg-1", "kg m-2 s-1", "mm/day", "hectopascal", "metre", "m s-1", "knots")
UNIT_NORM = ("hpa", "m2s-2", "c", "g/kg", "mm/s", "mm/d", "hpa", "m", "m/s", "knot")


@query(f"select p_partkey, ([{', '.join(map(repr, UNIT_NORM))}])[p_partkey % 10 + 1] as unit from part")
def unit_norm(spark, sf_dir):
    names = F.array(*map(F.lit, UNIT_NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", units.normalised(F.get(names, (F.col("p_partkey") % 10).cast("int"))).alias("unit"))


@query("""with c(i, var_class, unit, factor, off) as (values (0, 'msl', 'hPa', 100.0::double, 0.0::double), (1, 't', 'degC', 1.0, 273.15), (2, 'z', 'gpm', 9.81, 0.0), (3, 'q', 'g kg-1', 0.001, 0.0))
    select p_partkey, c.var_class, round(p_retailprice * factor + off, 6) as value from part join c on c.i = p_partkey % 4""")
def unit_convert(spark, sf_dir):
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", pick(("msl", "t", "z", "q")).alias("var_class"), pick(("hPa", "degC", "gpm", "g kg-1")).alias("unit"))
    return rounded(units.convert(units.lookup(rows), "p_retailprice", "value").select("p_partkey", "var_class", "value"), "value")


@query(f"with {FIELD} select t, iy, ix, round(sqrt(v * v + (2 * v) * (2 * v)), 6) as speed, round(sqrt(pow(v * 0.5, 2) + pow(2 * v * 0.5, 2)), 6) as flux, round((53000 + 2500 * v) / 9.81, 6) as height, round((101325 - 2000 * v) / 100, 6) as hpa from f")
def magnitudes(spark, sf_dir):
    f = dense(spark, sf_dir).select("t", "iy", "ix", F.col("v").alias("u"), (2 * F.col("v")).alias("w"), F.lit(0.5).alias("q"), (53000 + 2500 * F.col("v")).alias("z"), (101325 - 2000 * F.col("v")).alias("msl"))
    return f.select("t", "iy", "ix", F.round(geo.magnitude("u", "w"), 6).alias("speed"), F.round(geo.flux_magnitude("u", "w", "q"), 6).alias("flux"), F.round(geo.geopotential_height("z"), 6).alias("height"), F.round(geo.to_hpa("msl"), 6).alias("hpa"))


ANOM = f"{box('f', 's', 1, 3)}, {box('f', 'b', 13, 61)}, a as (select s.segment, s.t, s.iy, s.ix, s.v - b.v as anom from s join b using (segment, t, iy, ix))"


@query(f"with {FIELD}, {ANOM} select segment, t, iy, ix, round(anom, 6) as anom from a")
def anomaly(spark, sf_dir):
    return rounded(derive.anomaly(dense(spark, sf_dir), 2, 13, 60, shape=(NY, NX)), "anom")


@query(f"{WITH} select f.segment, f.t, f.iy, f.ix, case when l.obj is null then 0.0::double else f.v end as v from f left join l using (t, iy, ix)")
def mask_by_label(spark, sf_dir):
    return derive.mask_by_label(dense(spark, sf_dir), found(spark, sf_dir))


GRADIENT = "coalesce((lead(v) over w - lag(v) over w) / 2, lead(v) over w - v, v - lag(v) over w)"


@query(f"with {FIELD}, x as (select t, iy, ix, {GRADIENT} as gx from f window w as (partition by t, iy order by ix)), y as (select t, iy, ix, {GRADIENT} as gy from f window w as (partition by t, ix order by iy)) select t, iy, ix, round(gx, 6) as gx, round(gy, 6) as gy from x join y using (t, iy, ix)")
def gradients(spark, sf_dir):
    return dense(spark, sf_dir).select("t", "iy", "ix", F.round(derive.gradient("v", "ix"), 6).alias("gx"), F.round(derive.gradient("v", "iy"), 6).alias("gy"))


def front_field(spark, sf_dir):
    return dense(spark, sf_dir).select(*CELL, (20 * F.col("v")).alias("u"), (15 * F.col("v") + F.col("ix")).alias("v"), (270 + 50 * F.col("v")).alias("temp"))


def _grad(c: str, axis: str) -> str:
    w = f"over (partition by t, {'iy' if axis == 'ix' else 'ix'} order by {axis})"
    return f"coalesce((lead({c}) {w} - lag({c}) {w}) / 2, lead({c}) {w} - {c}, {c} - lag({c}) {w})"


DIAG = f"""ff as (select t, iy, ix, 20 * v as u, 15 * v + ix as w, 270 + 50 * v as temp from f),
    fg as (select t, iy, ix, {_grad('w', 'ix')} as wx, {_grad('u', 'iy')} as uy, {_grad('temp', 'ix')} as tx, {_grad('temp', 'iy')} as ty from ff),
    diag as (select fg.t, fg.iy, fg.ix, abs(wx / dx + uy / dy) * sqrt(pow(tx / dx, 2) + pow(ty / dy, 2)) * 100000 / (2 * 7.292115e-5 * sin(radians(lat)) * 0.45) as diag from fg join ga using (iy, ix))"""


@query(f"with {FIELD}, {GRID}, {METRICS}, {DIAG} select t, iy, ix, round(diag, 5) as diag from diag")
def front_diagnostic(spark, sf_dir):
    return rounded(derive.front_diagnostic(front_field(spark, sf_dir), full_grid(spark), -1).drop("segment"), "diag", places=5)


@query(f"with {FIELD}, {GRID}, {METRICS}, {DIAG} select t, iy, ix, round(case when (iy + ix) % 3 = 0 then 0 else abs(diag) end, 5) as diag from diag")
def front_masked(spark, sf_dir):
    mask = plain_grid(spark).select("iy", "ix", F.when((F.col("iy") + F.col("ix")) % 3 == 0, 0).otherwise(1).alias("mask"))
    return rounded(derive.front_diagnostic(front_field(spark, sf_dir), full_grid(spark), -1, mask).drop("segment"), "diag", places=5)


# ---- F: stencils


@query(f"with {FIELD}, {box('f', 's', 3, 5)} select t, iy, ix, round(v, 6) as v from s")
def box_mean(spark, sf_dir):
    return rounded(stencil.box_mean(dense(spark, sf_dir), 3, 5, shape=(NY, NX)).drop("segment"), "v")


@query(f"with {FIELD}, {box('f', 's', 13, 61)} select t, iy, ix, round(v, 6) as v from s")
def box_mean_background(spark, sf_dir):
    return rounded(stencil.box_mean(dense(spark, sf_dir), 13, 60, shape=(NY, NX)).drop("segment"), "v")


@query(f"""with {FIELD}, s as (select c.t, c.iy, c.ix, avg(s.v) as v from f c, range(-1, 2) o(d) join f s on s.t = c.t and s.iy = c.iy and s.ix = (c.ix + o.d + 8) % 8 group by all),
    u as (select c.t, c.iy, c.ix, avg(s.v) as v from s c, range(-1, 2) o(d) join s on s.t = c.t and s.ix = c.ix and s.iy = greatest(0, least(7, c.iy + o.d)) group by all) select t, iy, ix, round(v, 6) as v from u""")
def box_mean_wrapped(spark, sf_dir):
    return rounded(stencil.box_mean(dense(spark, sf_dir), 1, 3, wrap_lon=True).drop("segment"), "v")


_WEIGHTS = "k as (select d, exp(-0.5 * d * d) / (select sum(exp(-0.5 * e * e)) from range(-4, 5) q(e)) as w from range(-4, 5) r(d))"


def _mirror(axis: str, n: str = "8") -> str:
    j = f"(((c.{axis} + k.d) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"case when {j} < {n} then {j} else 2 * {n} - 1 - {j} end"


@query(f"""with {FIELD}, {_WEIGHTS}, a as (select c.t, c.iy, c.ix, sum(k.w * s.v) as v from f c, k join f s on s.t = c.t and s.ix = c.ix and s.iy = {_mirror('iy')} group by all),
    b as (select c.t, c.iy, c.ix, sum(k.w * s.v) as v from a c, k join a s on s.t = c.t and s.iy = c.iy and s.ix = {_mirror('ix')} group by all) select t, iy, ix, round(v, 6) as v from b""")
def gaussian_xy(spark, sf_dir):
    return rounded(stencil.gaussian(dense(spark, sf_dir), 1.0).drop("segment"), "v")


@query(f"""with {FIELD}, {_WEIGHTS}, p as (select iy, ix, t, case when v > -0.3 then v end as v from f), n as (select max(t) + 1 as n from f),
    s as (select c.iy, c.ix, c.t, sum(k.w * s.v) as v, count(s.v) as m from p c, k, n join p s on s.iy = c.iy and s.ix = c.ix and s.t = {_mirror('t', 'n.n')} group by all)
    select iy, ix, t, round(case when m = 9 then v end, 6) as smooth from s""")
def gaussian_series(spark, sf_dir):
    rows = dense(spark, sf_dir).select("iy", "ix", "t", F.when(F.col("v") > -0.3, F.col("v")).alias("v"))
    return rounded(stencil.gaussian_series(rows, ("iy", "ix"), "v", "smooth").select("iy", "ix", "t", "smooth"), "smooth")


@query(f"with {FIELD}, n as (select a.t, a.iy, a.ix, a.v, max(b.v) as m from f a join f b on b.t = a.t and abs(a.iy - b.iy) <= 1 and abs(a.ix - b.ix) <= 1 group by all) select t, iy, ix, v from n where v = m and v > 0.2")
def local_maxima(spark, sf_dir):
    return stencil.local_maxima(dense(spark, sf_dir), THRESHOLD).select("t", "iy", "ix", "v")


@query(f"""with recursive {FIELD}, c as (select t, iy, ix from f where v > 0.15), {components('c', 'l')},
    n as (select a.t, a.iy, a.ix, a.v, max(b.v) as m from f a join f b on b.t = a.t and abs(a.iy - b.iy) <= 1 and abs(a.ix - b.ix) <= 1 group by all),
    k as (select t, iy, ix, v, obj, row_number() over (partition by t, obj order by v desc, iy, ix) as r from n join l using (t, iy, ix) where v = m and v > 0.15 and iy between 1 and 6 and ix between 1 and 6),
    e as (select a.t, a.obj, a.r, coalesce(list(b.r) filter (where b.r is not null), []) as before from k a left join k b on a.t = b.t and a.obj = b.obj and b.r < a.r and abs(a.iy - b.iy) <= 1 and abs(a.ix - b.ix) <= 1 group by all),
    s as (select t, obj, list_reduce(list([r] || before order by r), lambda acc, x: case when list_has_any(acc, x[2:]) then acc else list_append(acc, x[1]) end) as kept from e group by all)
    select 0 as segment, k.t, k.iy, k.ix, k.obj as obj_id, k.v from k join s using (t, obj) where list_contains(s.kept, k.r)""")
def peaks(spark, sf_dir):
    return stencil.peaks(dense(spark, sf_dir), found(spark, sf_dir, 0.15), 1, 0.15, NY, NX)


@query(f"{WITH}, s as (select obj, t, count(*) as n from l group by all), w as (select a.obj from s a join s b on a.obj = b.obj and b.t between a.t and a.t + 1 where b.n >= 2 group by a.obj, a.t having count(*) = 2) select distinct obj as obj_id from w")
def sliding_all(spark, sf_dir):
    per = found(spark, sf_dir).groupBy(*OBJ, "t").agg(F.count("*").alias("n"))
    return objects.sustained(per, "n >= 2", 2).select("obj_id")


# ---- G: labels and the object graph


@query(f"{WITH} select obj as obj_id, t, iy, ix from l")
def label3d(spark, sf_dir):
    return found(spark, sf_dir).select("obj_id", "t", "iy", "ix")


@query(f"with recursive {FIELD}, {CELLS}, {components('c', 'l', '2d8')} select obj as obj_id, t, iy, ix from l")
def label2d_8(spark, sf_dir):
    return label.label(dense(spark, sf_dir).where("v > 0.2"), NY, NX, through_time=False).select("obj_id", "t", "iy", "ix")


@query(f"with recursive {FIELD}, {CELLS}, {components('c', 'l', '2d4')} select obj as obj_id, t, iy, ix from l")
def label2d_4(spark, sf_dir):
    return label.label(dense(spark, sf_dir).where("v > 0.2"), NY, NX, diagonal=False, through_time=False).select("obj_id", "t", "iy", "ix")


@query(f"with recursive {FIELD}, {CELLS}, {components('c', 'l', seam=True)} select obj as obj_id, t, iy, ix from l")
def label3d_periodic(spark, sf_dir):
    return label.label(dense(spark, sf_dir).where("v > 0.2"), NY, NX, periodic=True).select("obj_id", "t", "iy", "ix")


_SEAM = """met as (select distinct a.t, a.obj as a, b.obj as b from l a join l b on a.t = b.t and a.iy = b.iy and a.ix = 7 and b.ix = 0 and a.obj <> b.obj),
    both_ as (select {t}, a, b from met union select {t}, b, a from met), r(t, id, m) as (select t, a, a from both_ union select b.t, b.b, r.m from r join both_ b on b.t = r.t and b.a = r.id where r.m < b.b),
    to_ as (select t, id, min(m) as m from r group by all)"""


@query(f"{WITH}, {_SEAM.format(t='0 as t')} select coalesce(m, obj) as obj_id, l.t, iy, ix from l left join to_ on to_.id = l.obj")
def seam_merge(spark, sf_dir):
    return label.seam_merge(found(spark, sf_dir), NX).select("obj_id", "t", "iy", "ix")


@query(f"{WITH}, {_SEAM.format(t='t')} select coalesce(m, obj) as obj_id, l.t, iy, ix from l left join to_ on to_.id = l.obj and to_.t = l.t")
def seam_merge_step(spark, sf_dir):
    return label.seam_merge(found(spark, sf_dir), NX, per_step=True).select("obj_id", "t", "iy", "ix")


@query(f"{WITH}, {lifetime('l', 'k', 2)} select obj as obj_id, t, iy, ix from k")
def lifetime_filter(spark, sf_dir):
    return objects.lifetime_filter(found(spark, sf_dir), 2).select("obj_id", "t", "iy", "ix")


@query(f"{WITH} select dense_rank() over (order by obj) as obj_id, t, iy, ix from l")
def relabel(spark, sf_dir):
    return label.relabel(found(spark, sf_dir)).select("obj_id", "t", "iy", "ix")


@query(f"{WITH} select obj as obj_id, min(t) as t0, max(t) as t1, min(iy) as iy0, max(iy) as iy1, min(ix) as ix0, max(ix) as ix1 from l group by obj")
def bounding_boxes(spark, sf_dir):
    return label.bounding_boxes(found(spark, sf_dir)).drop("segment")


@query(f"{WITH}, s as (select distinct iy, ix, t from c), i as (select *, t - row_number() over (partition by iy, ix order by t) as g from s) select iy, ix, min(t) as first, count(*) as n from i group by iy, ix, g")
def islands(spark, sf_dir):
    cells = dense(spark, sf_dir).where("v > 0.2").select("iy", "ix", "t")
    return timeaxis.consecutive(cells, ("iy", "ix")).groupBy("iy", "ix", "run").agg(F.min("t").alias("first"), F.count("*").alias("n")).drop("run")


LOW = f"with recursive {FIELD}, c as (select * from f where v > 0.15), {components('c', 'l')}"
_PARTS = f"{LOW}, {components('(select t, iy, ix, obj as own from l)', 'p', '2d8', key='own')}"


@query(f"{_PARTS}, s as (select own, t, count(distinct obj) as n from p group by all) select own as obj_id, round(sum(n) / (max(t) - min(t) + 1)::double, 6) as mean_parts from s group by own")
def part_counts(spark, sf_dir):
    return rounded(forest.part_counts(forest.parts(found(spark, sf_dir, 0.15), NY, NX)).drop("segment"), "mean_parts")


_BREAK = f"{LOW}, {lifetime('l', 'k', 2)}, {break_up('k', 'z', 2)}"


@query(f"{LOW}, {lifetime('l', 'k', 2)}, {break_up('k', 'z', 2)} select f.own as obj_id, f.t, f.part, f.q as parent from z_f f")
def breakup_parents(spark, sf_dir):
    cells = forest.parts(objects.lifetime_filter(found(spark, sf_dir, 0.15), 2), NY, NX)
    many = forest.part_counts(cells).where("mean_parts > 1.5").select(*OBJ)
    return forest.part_parents(cells.join(many, list(OBJ), "left_semi")).where("parent is not null").select("obj_id", "t", "part", "parent")


@query(f"{_BREAK} select obj as obj_id, t, iy, ix from z")
def breakup_objects(spark, sf_dir):
    return forest.break_up(objects.lifetime_filter(found(spark, sf_dir, 0.15), 2), NY, NX, 2).select("obj_id", "t", "iy", "ix")


_OVER = "o as (select b.t, a.obj as before_id, b.obj as obj_id, count(*) as n from l a join l b on b.t = a.t + 1 and a.iy = b.iy and a.ix = b.ix group by all)"


@query(f"{WITH}, {_OVER} select t, before_id, obj_id, n from o")
def overlap_counts(spark, sf_dir):
    return objects.overlaps(found(spark, sf_dir)).drop("segment")


@query(f"""with recursive {FIELD}, c as (select * from f where v > 0.1), {components('c', 'l', '2d8')}, {_OVER}, sz as (select t, obj, count(*) as size from l group by all),
    ch as (select * from o qualify row_number() over (partition by t, before_id order by n desc, obj_id) = 1),
    w as (select ch.* from ch join sz on sz.t = ch.t - 1 and sz.obj = ch.before_id qualify row_number() over (partition by ch.t, ch.obj_id order by size desc, before_id) = 1)
    select distinct l.t, l.obj as node, w.before_id as parent from l left join w on w.t = l.t and w.obj_id = l.obj""")
def basin_links(spark, sf_dir):
    basins = staged(label.label(dense(spark, sf_dir).where("v > 0.1"), NY, NX, through_time=False), "basins")
    sizes = basins.groupBy("segment", "t", "obj_id").agg(F.count("*").alias("size"))
    return forest.link_basins(basins, sizes).drop("segment")


_REGION = f"{LOW}, {components('(select t, iy, ix, obj as own from l)', 'p', '2d4', key='own')}"


@query(f"{_REGION} select own as obj_id, t, iy, ix, obj as part from p")
def split_regions(spark, sf_dir):
    return split.regions(found(spark, sf_dir, 0.15), NY, NX).drop("segment")


@query(f"""{_REGION}, m as (select t, obj as piece, avg(iy) as y, avg(ix) as x from p group by all),
    n as (select b.t, b.piece, a.piece as parent, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) as d from m a join m b on b.t = a.t + 1), k as (select * from n where d < 3 qualify row_number() over (partition by t, piece order by d, parent) = 1)
    select m.t, m.piece, k.parent from m left join k using (t, piece)""")
def nearest_before(spark, sf_dir):
    pieces = split.regions(found(spark, sf_dir, 0.15), NY, NX).withColumnRenamed("part", "piece")
    return split.nearest_before(pieces, 3.0).drop("segment")


def split_sql(src: str, far: float) -> str:
    """CTEs for objects split where parts are far apart and followed by nearest centres: so (obj, t, iy, ix). src has obj."""
    return f"""{components(f'(select t, iy, ix, obj as own from {src})', 'p', '2d4', key='own')},
    oc as (select k.t, k.own, y, x from (select distinct t, own from p) k, range(8) a(y), range(8) b(x) where not exists (select 1 from p where p.t = k.t and p.own = k.own and p.iy = y and p.ix = x)),
    dd as (select p.t, p.own, p.obj as part, p.iy, p.ix, min(sqrt(pow(p.iy - oc.y, 2) + pow(p.ix - oc.x, 2))) as d from p left join oc on oc.t = p.t and oc.own = p.own group by all),
    mid as (select t, own, part, avg(iy) as cy, avg(ix) as cx, max(coalesce(d, 'inf'::double)) as depth from dd group by all),
    apart as (select distinct b.t, b.own, b.part from mid a join mid b on a.t = b.t and a.own = b.own and a.part < b.part where sqrt(pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2)) > {far} or (a.depth > {far} and b.depth > {far})),
    named as (select m.t, m.own, m.part, case when a.part is not null then m.part else min(m.part) over (partition by m.t, m.own) end as piece from mid m left join apart a using (t, own, part)),
    pc as materialized (select p.t, p.iy, p.ix, n.piece from p join named n on n.t = p.t and n.own = p.own and n.part = p.obj),
    mp as (select t, piece, avg(iy) as y, avg(ix) as x from pc group by all), np as (select b.t, b.piece, a.piece as parent, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) as d from mp a join mp b on b.t = a.t + 1),
    kp as materialized (select mp.t, mp.piece, w.parent from mp left join (select * from np where d < {far} qualify row_number() over (partition by t, piece order by d, parent) = 1) w using (t, piece)),
    rp(t, piece, root) as (select t, piece, piece from kp where parent is null union all select kp.t, kp.piece, rp.root from kp join rp on rp.t = kp.t - 1 and rp.piece = kp.parent),
    so as materialized (select rp.root as obj, pc.t, pc.iy, pc.ix from pc join rp using (t, piece))"""


@query(f"{LOW}, {split_sql('l', 3)} select 0 as segment, obj as obj_id, t, iy, ix from so")
def split_objects(spark, sf_dir):
    return split.split_objects(found(spark, sf_dir, 0.15), NY, NX, 3)


@query(f"{WITH}, k as (select obj, row_number() over (order by obj) as new from l group by obj having max(t) - min(t) >= 1) select obj_id, other_id from (select k.new as obj_id, coalesce(j.new, -1)::bigint as other_id from (select distinct a.obj as a, b.obj as b from l a join l b on a.t = b.t and a.iy = b.iy and a.obj < b.obj) e join k on k.obj = e.a left join k j on j.obj = e.b)")
def translated_links(spark, sf_dir):
    cells = found(spark, sf_dir)
    links = cells.join(cells.select("segment", "t", "iy", F.col("obj_id").alias("other_id")), ["segment", "t", "iy"]).where("obj_id < other_id").select("segment", "obj_id", "other_id").distinct()
    kept = cells.groupBy(*OBJ).agg((F.max("t") - F.min("t")).alias("n")).where("n >= 1")
    from pyspark.sql import Window

    mapping = kept.select(*OBJ, F.row_number().over(Window.partitionBy("segment").orderBy("obj_id")).cast("long").alias("new_id"))
    return objects.translate_links(links, mapping).select("obj_id", "other_id")


# ---- H: statistics


AREA = f"{GRID}, {METRICS}"
OBJECTS = f"with recursive {FIELD}, {CELLS}, {components('c', 'l')}, {AREA}"


@query(f"{OBJECTS} select obj as obj_id, t, round(sum(area), 0) as area from l join ga using (iy, ix) group by all")
def object_area(spark, sf_dir):
    return rounded(objects.areas(found(spark, sf_dir), full_grid(spark)).drop("segment"), "area", places=0)


@query(f"""{OBJECTS}, s as (select obj, t, sum(area) as area from l join ga using (iy, ix) group by all), i as (select *, t - row_number() over (partition by obj order by t) as g from s where area >= 1.5e9),
    k as (select distinct obj from i group by obj, g having count(*) >= 2) select dense_rank() over (order by obj) as obj_id, t, iy, ix from l where obj in (select obj from k)""")
def large_and_long(spark, sf_dir):
    return objects.large_and_long(found(spark, sf_dir), full_grid(spark), 1.5e9, 2).select("obj_id", "t", "iy", "ix")


@query(f"""{OBJECTS}, s as (select obj, t, sum(area) as size, min(v) as min, max(v) as max, avg(v) as mean, sum(v) as tot, avg(iy) as cy, avg(ix) as cx from l join ga using (iy, ix) group by all),
    bx as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj),
    r as (select s.*, least(greatest(round_even(cy - y0, 0) + y0, y0), y1)::int as iy, least(greatest(round_even(cx - x0, 0) + x0, x0), x1)::int as ix, count(*) over (partition by obj) as n from s join bx using (obj)),
    d as (select r.*, case when lag(t) over w = t - 1 then sqrt(pow(cy - lag(cy) over w, 2) + pow(cx - lag(cx) over w, 2)) * 50 end as speed from r where n >= 2 window w as (partition by obj order by t))
    select obj as obj_id, t, round(size, 0) as size, min, max, round(mean, 6) as mean, round(tot, 6) as tot, round(cy, 6) as cy, round(cx, 6) as cx, lat, lon, round(speed, 6) as speed, round(speed / 6, 6) as speed_kmh from d join ga using (iy, ix)""")
def object_stats(spark, sf_dir):
    out = objects.statistics(found(spark, sf_dir), dense(spark, sf_dir), full_grid(spark), 50_000.0, 6.0, 2).drop("segment")
    return rounded(out, "mean", "tot", "cy", "cx", "speed", "speed_kmh").withColumn("size", F.round("size", 0))


@query(f"{WITH} select obj as obj_id, t, (arg_min(id, (v, id)) % 64 // 8)::int as iy, (arg_min(id, (v, id)) % 8)::int as ix, min(v) as v from l group by all")
def argmin_cells(spark, sf_dir):
    return objects.argmin_cells(found(spark, sf_dir), dense(spark, sf_dir), NX).drop("segment")


@query(f"{OBJECTS} select obj as obj_id, round(sum(area), 0) as area from l join ga using (iy, ix) group by obj having sum(area) >= 2e9")
def object_total_area(spark, sf_dir):
    return rounded(objects.area_sums(objects.min_total_area(found(spark, sf_dir), full_grid(spark), 2e9), full_grid(spark)).drop("segment"), "area", places=0)


CENTRES = "ce as (select obj, t, (arg_min(id, (v, id)) % 64 // 8)::int as cy, (arg_min(id, (v, id)) % 8)::int as cx, min(v) as low from l group by all)"


def centres(spark, sf_dir):
    rows = objects.argmin_cells(found(spark, sf_dir), dense(spark, sf_dir), NX).withColumnRenamed("v", "low")
    rows = rows.withColumns({"y0": F.lit(0), "y1": F.lit(NY - 1), "x0": F.lit(0), "x1": F.lit(NX - 1)})
    return rows.join(plain_grid(spark), ["iy", "ix"])


@query(f"""{OBJECTS}, {CENTRES}, r as (select ce.obj, ce.t, f.v - ce.low > 0 as high from ce join g k on k.iy = ce.cy and k.ix = ce.cx join f on f.t = ce.t and abs(f.iy - ce.cy) <= 3 and abs(f.ix - ce.cx) <= 3 join g on g.iy = f.iy and g.ix = f.ix
    where abs({haversine('k.lat', 'k.lon', 'g.lat', 'g.lon')} - 60000) <= 20000) select obj as obj_id, t, count(*) as ring, count(*) filter (where high) as high from r group by all""")
def ring_fraction(spark, sf_dir):
    return objects.ring_fraction(centres(spark, sf_dir), dense(spark, sf_dir), plain_grid(spark), 60_000.0, 20_000.0, 0.0, 3).drop("segment")


@query(f"{OBJECTS}, {CENTRES} select ce.obj as obj_id, ce.t, count(*) as n, min(f.v) as least from ce join f on f.t = ce.t and f.ix = ce.cx and f.iy < ce.cy group by all")
def poleward_column(spark, sf_dir):
    return objects.poleward_column(centres(spark, sf_dir), dense(spark, sf_dir), -1).drop("segment")


@query(f"""{OBJECTS}, {CENTRES}, bx as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj)
    select ce.obj as obj_id, ce.t, round(avg(f.v), 6) as core from ce join bx using (obj) join f on f.t = ce.t and abs(f.iy - cy) <= 1 and abs(f.ix - cx) <= 1 and f.iy between y0 and y1 and f.ix between x0 and x1 group by all""")
def core_means(spark, sf_dir):
    return rounded(objects.core_means(centres(spark, sf_dir).select(*OBJ, "t", "iy", "ix"), found(spark, sf_dir), dense(spark, sf_dir)).drop("segment"), "core")


@query(f"{WITH}, s as (select obj, t, max(v) as top from l group by all) select obj as obj_id, count(*) filter (where top > 0.25) as hits, max(t) filter (where top > 0.25) - min(t) filter (where top > 0.25) + 1 as span from s group by obj")
def step_counts(spark, sf_dir):
    top = found(spark, sf_dir).join(dense(spark, sf_dir), list(CELL)).groupBy(*OBJ, "t").agg(F.max("v").alias("top"))
    hit = F.col("top") > 0.25
    return top.groupBy("obj_id").agg(F.count_if(hit).alias("hits"), (F.max(F.when(hit, F.col("t"))) - F.min(F.when(hit, F.col("t"))) + 1).alias("span"))


@query(f"{WITH} select count(distinct obj) as objects, count(*) as cells from l")
def object_counts(spark, sf_dir):
    return found(spark, sf_dir).agg(F.count_distinct("obj_id").alias("objects"), F.count("*").alias("cells"))


CLOUD = f"with recursive {FIELD}, {CELLS}, d as (select * from f where v > 0.1 and iy < 6), {components('c', 'l')}, {components('d', 'q', '2d8')}, {AREA}"


def clouds(spark, sf_dir):
    return staged(label.label(dense(spark, sf_dir).where("v > 0.1 and iy < 6"), NY, NX, through_time=False), "clouds")


@query(f"""{CLOUD}, pr as (select distinct l.obj, q.obj as cloud from l join q using (t, iy, ix)), st as (select distinct obj, t from l)
    select pr.obj as obj_id, st.t, round(sum(area), 0) as area from pr join st using (obj) join q on q.obj = pr.cloud and q.t = st.t join ga on ga.iy = q.iy and ga.ix = q.ix group by all""")
def whole_cloud_area(spark, sf_dir):
    return rounded(objects.whole_cloud_area(found(spark, sf_dir), clouds(spark, sf_dir), full_grid(spark)).drop("segment"), "area", places=0)


@query(f"""{CLOUD}, bx as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj), st as (select distinct obj, t from l)
    select st.obj as obj_id, st.t, coalesce(min(q.v), 999.0) as low from st join bx using (obj) left join q on q.t = st.t and q.iy between y0 and y1 and q.ix between x0 and x1 group by all""")
def box_minimum(spark, sf_dir):
    return objects.box_minimum(found(spark, sf_dir), clouds(spark, sf_dir), dense(spark, sf_dir)).drop("segment")


@query(f"{WITH}, s as (select obj, t, avg(iy) as cy, avg(ix) as cx from l group by all) select obj as obj_id, t, round(case when lag(t) over w = t - 1 then sqrt(pow(cy - lag(cy) over w, 2) + pow(cx - lag(cx) over w, 2)) * 50 end, 6) as km from s window w as (partition by obj order by t)")
def position_steps(spark, sf_dir):
    mid = found(spark, sf_dir).groupBy(*OBJ, "t").agg(F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    return rounded(objects.position_steps(mid, 50_000.0).select("obj_id", "t", "km"), "km")


# ---- E and M: thresholds and trackers. Values are affine in the vectors', so that thresholds cut off a few hundredths of the cells.


@query(f"""with {FIELD} select count(*) filter (where 400 * v < -80) as z_low, count(*) filter (where 400 * v > 70) as z_high, count(*) filter (where 25 * v < -5) as p_low, count(*) filter (where 60 * v > 12) as p_high,
    count(*) filter (where 120 * v >= 24) as jet, count(*) filter (where 0.65 * v > 0.13) as flux, count(*) filter (where 2500 * v > 500) as ivt, count(*) filter (where 150 * v >= 30) as rain, count(*) filter (where 261 - 100 * v <= 241) as cloud, count(*) filter (where 2.5 * v > 0.5) as front from f""")
def thresholds(spark, sf_dir):
    v = F.col("v")
    tests = {"z_low": 400 * v < Z500.cyclone, "z_high": 400 * v > Z500.anticyclone, "p_low": 25 * v < Slp.cyclone, "p_high": 60 * v > Slp.anticyclone, "jet": 120 * v >= Jet.speed, "flux": 0.65 * v > River.flux, "ivt": 2500 * v > River.ivt, "rain": 150 * v >= 5 * 6, "cloud": 261 - 100 * v <= 241, "front": 2.5 * v > Front.diag}
    return dense(spark, sf_dir).agg(*(F.count_if(c).alias(n) for n, c in tests.items()))


def _tracker(value: str, test: str, small: int, n: int, background: int = 61) -> str:
    """SQL of the trackers of the anomaly kind."""
    small_sql = box("x", "s", 1, small)
    return f"""with recursive {FIELD}, x as (select segment, t, iy, ix, {value} as v from f), {small_sql}, {box('x', 'b', 13, background)},
        c as (select s.t, s.iy, s.ix from s join b using (segment, t, iy, ix) where s.v - b.v {test}), {components('c', 'l')}, {lifetime('l', 'k', n)}, {break_up('k', 'z', n)} select obj as obj_id, t, iy, ix from z"""


def _z(spark, sf_dir):
    return dense(spark, sf_dir).withColumn("v", 53000 + 12000 * F.col("v"))


@query(_tracker("(53000 + 12000 * v) / 9.81", "< -80", 3, 2))
def cyclones_z500(spark, sf_dir):
    return trackers.cyclones_z500(_z(spark, sf_dir), DOMAIN).select("obj_id", "t", "iy", "ix")


@query(_tracker("(53000 + 12000 * v) / 9.81", "> 70", 3, 2))
def anticyclones_z500(spark, sf_dir):
    return trackers.cyclones_z500(_z(spark, sf_dir), DOMAIN, high=True).select("obj_id", "t", "iy", "ix")


def _p(spark, sf_dir):
    return dense(spark, sf_dir).withColumn("v", 101325 + 10000 * F.col("v"))


@query(_tracker("(101325 + 10000 * v) / 100", "< -5", 3, 2))
def cyclones_slp(spark, sf_dir):
    return trackers.cyclones_slp(_p(spark, sf_dir), full_grid(spark), DOMAIN, Slp(watershed=False)).select("obj_id", "t", "iy", "ix")


@query(_tracker("(101325 + 20000 * v) / 100", "> 12", 3, 2))
def anticyclones_slp(spark, sf_dir):
    msl = dense(spark, sf_dir).withColumn("v", 101325 + 20000 * F.col("v"))
    return trackers.cyclones_slp(msl, full_grid(spark), DOMAIN, Slp(watershed=False), high=True).select("obj_id", "t", "iy", "ix")


@query()
def cyclones_slp_watershed(spark, sf_dir):
    return trackers.cyclones_slp(_p(spark, sf_dir), full_grid(spark), DOMAIN, Slp(peak_km=50.0, window_km=50.0, window_h=1.0)).select("obj_id", "t", "iy", "ix")


def _wind(spark, sf_dir):
    return dense(spark, sf_dir).select(*CELL, (800 * F.col("v")).alias("u"), (300 * F.col("v")).alias("v"))


@query(_tracker("sqrt(pow(800 * v, 2) + pow(300 * v, 2))", ">= 24", 3, 4, 101))
def jets(spark, sf_dir):
    return trackers.jets(_wind(spark, sf_dir), full_grid(spark), DOMAIN, Jet(small_km=100.0)).select("obj_id", "t", "iy", "ix")


@query()
def jets_watershed(spark, sf_dir):
    return trackers.jets(_wind(spark, sf_dir), full_grid(spark), DOMAIN, Jet(small_km=100.0, watershed=True, peak_km=50.0, window_km=50.0, window_h=1.0)).select("obj_id", "t", "iy", "ix")


@query(f"""with recursive {FIELD}, c as (select t, iy, ix from f where sqrt(pow(0.6 * v, 2) + pow(0.06 * v, 2)) > 0.13), {components('c', 'l')}, {AREA},
    s as (select obj, t, sum(area) as area from l join ga using (iy, ix) group by all), k as (select t, iy, ix, dense_rank() over (order by obj) as obj from l where obj in (select obj from s where area >= 1.5e9)), {break_up('k', 'z', 0)} select obj as obj_id, t, iy, ix from z""")
def rivers_flux(spark, sf_dir):
    f = dense(spark, sf_dir).select(*CELL, F.col("v").alias("u"), (0.1 * F.col("v")).alias("v"), F.lit(0.6).alias("q"))
    return trackers.rivers_flux(f, full_grid(spark), DOMAIN, River(area_km2=1500.0)).select("obj_id", "t", "iy", "ix")


@query(f"with recursive {FIELD}, c as (select t, iy, ix from f where 2500 * abs(v) > 500), {components('c', 'l')}, {lifetime('l', 'k', 1)}, {break_up('k', 'z', 1)} select obj as obj_id, t, iy, ix from z")
def rivers_ivt(spark, sf_dir):
    f = dense(spark, sf_dir).select(*CELL, (2500 * F.col("v")).alias("ivte"), F.lit(0.0).alias("ivtn"))
    return trackers.rivers_ivt(f, DOMAIN).select("obj_id", "t", "iy", "ix")


@query(f"with recursive {FIELD}, {GRID}, {METRICS}, {DIAG}, c as (select t, iy, ix from diag where diag > 20), {components('c', 'l', '2d8')} select obj as obj_id, t, iy, ix from l where obj in (select obj from l join ga using (iy, ix) group by obj having sum(area) >= 3e9)")
def fronts(spark, sf_dir):
    return trackers.fronts(front_field(spark, sf_dir), full_grid(spark), DOMAIN, Front(diag=20.0, area_km2=3000.0)).select("obj_id", "t", "iy", "ix")


# ---- calendars


@query("""select l_orderkey, l_linenumber, (2001 + (l_orderkey * 24 // 24) // 365)::int as year, (l_orderkey % 365)::int as of_year,
    (select count(*)::int from unnest([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]) m(s) where s <= l_orderkey % 365) as month from lineitem""")
def noleap_dates(spark, sf_dir):
    h = F.col("l_orderkey") * 24
    p = calendars.parts(h, "noleap", 2001)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p["year"].alias("year"), (F.floor(h / 24) % 365).cast("int").alias("of_year"), p["month"].alias("month"))


@query("select l_orderkey, l_linenumber, (2001 + l_orderkey // 8640)::int as year, ((l_orderkey // 24) % 360 // 30 + 1)::int as month, ((l_orderkey // 24) % 30 + 1)::int as day, (l_orderkey % 24)::int as hour from lineitem")
def day360_dates(spark, sf_dir):
    p = calendars.parts(F.col("l_orderkey"), "360_day", 2001)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(p[k].alias(k) for k in ("year", "month", "day", "hour")))
