"""Registered queries on streams, files and the time axis."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F


from .operators import grid, label, objects, timeaxis
from .operators.stencil import CELL
from .plans import checks, jobs, trackers
from .plans.config import CutOff, Jet, Mcs, River, Slp, Tropical
from .queries import _WEIGHTS, DOMAIN, LAND, NX, NY, OBJECTS, WITH, _tracker, _wind, _z, clouds, dense, found, full_grid, rounded, split_sql, table, used_grid
from .registry import FIELD, GRID, HOURLY, METRICS, SQL, components, haversine, query
from .sources import buckets, fields, sinks, streams
from .sources import index as sources_index
from .storage import file_system, shared_dir, staged
from .streaming.linking import link_stream
from .streaming.windows import accumulate_stream


def hourly(spark, sf_dir):
    return fields.from_events(table(spark, sf_dir, "events"))


def stamps(spark, sf_dir):
    return hourly(spark, sf_dir).select("segment", "hour_idx").distinct()


# ---- A: sources and sinks


@query("select count(*) as n, min(ts) as first, max(ts) as last from events")
def scan_stream(spark, sf_dir):
    rows = streams.scan(spark, f"{sf_dir}/events.parquet")
    return rows.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("select event_id, ts from events where ts >= timestamp '2024-01-01' - interval 48 hours and ts < timestamp '2025-01-01' + interval 48 hours")
def year_scan(spark, sf_dir):
    return streams.year_scan(table(spark, sf_dir, "events"), 2024, 48).select("event_id", "ts")


@query("""with d as (select distinct 'y' || year(o_orderdate) as part, o_orderdate::timestamp as ts from orders), s as (select *, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by part order by ts))) / 3.6e9, 6) as d from d)
    select part, min(ts) as t0, max(ts) as t1, count(*) as n, mode(d)::double as step_h, 'standard' as calendar from s group by part""")
def file_index(spark, sf_dir):
    """Orders in a file for each year, and what times each file holds."""
    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    _by_year(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key")), at, "y")
    index = streams.file_index(spark.read.parquet(at))
    part = F.regexp_extract("path", "part=([a-z0-9]+)", 1).alias("part")
    return index.select(part, F.col("t0").cast("timestamp_ntz").alias("t0"), F.col("t1").cast("timestamp_ntz").alias("t1"), "n", "step_h", "calendar")


@query("""select distinct 'y' || year(l_shipdate) as part from lineitem where year(l_shipdate) = 1996 union all select distinct 'n' || year(l_shipdate) from lineitem where year(l_shipdate) between 1999 and 2000""")
def stale_files(spark, sf_dir):
    """Files of a listing that an index made before does not know: one was written again, two are new."""
    at, index, lines = _archive(spark, sf_dir)
    files, _ = file_system(spark, at)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/files/part=y1996"), True)
    _by_year(lines.where("year(ts) = 1996"), f"{at}/files", "y")
    _by_year(lines.where("year(ts) between 1999 and 2000"), f"{at}/files", "n")
    return streams.stale_files(sources_index.listing(spark, f"{at}/files"), index).select(F.regexp_extract("path", "part=([a-z0-9]+)", 1).alias("part"))


@query("select distinct year(o_orderdate)::int as year from orders")
def available_years(spark, sf_dir):
    index = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey")).agg(F.min("o_orderdate").alias("t0"), F.max("o_orderdate").alias("t1"))
    return streams.available_years(index)


@query("select distinct year(o_orderdate)::int as year from orders where year(o_orderdate) between 1993 and 1995")
def select_years(spark, sf_dir):
    index = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("t0"), F.max("o_orderdate").alias("t1"))
    return streams.select_years(streams.available_years(index), 1993, 1995)


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where year(l_shipdate) = 1995")
def slice_year(spark, sf_dir):
    return streams.slice_year(table(spark, sf_dir, "lineitem"), 1995, "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate")


def _written(spark, rows):
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    streams.write_segments(rows, path)
    return path


@query(f"{WITH} select f.t, f.iy, f.ix, coalesce(l.obj, 0)::int as obj_id, f.v, round(f.v * 2, 6) as w from f left join l using (t, iy, ix)")
def colocated_streams(spark, sf_dir):
    """Two streams and the objects of one, bucketed by step, side by side without an exchange."""
    buckets.colocated(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = buckets.bucketed(dense(spark, sf_dir).select(*CELL, "v"), n)
    other = buckets.bucketed(f.select(*CELL, (F.col("v") * 2).alias("w")), n)
    labels = buckets.bucketed(found(spark, sf_dir), n)
    return rounded(streams.dense(labels.hint("merge"), f.join(other.hint("merge"), list(CELL))).drop("segment"), "w")


@query(f"{WITH} select (f.t // 100)::int as segment, f.t, f.iy, f.ix, coalesce(l.obj, 0)::int as obj_id, f.v from f left join l using (t, iy, ix)")
def tracking_sink(spark, sf_dir):
    out = streams.dense(found(spark, sf_dir), dense(spark, sf_dir)).withColumn("segment", F.floor(F.col("t") / 100).cast("int"))
    return spark.read.parquet(_written(spark, out)).select("segment", "t", "iy", "ix", "obj_id", "v")


@query(_tracker("(53000 + 12000 * v) / 9.81", "< -80", 3, 2))
def year_job(spark, sf_dir):
    """A canonical stream written and loaded, cyclones tracked, written with the field, and read back as objects."""
    stream = _written(spark, _z(spark, sf_dir).withColumn("v", F.col("v").cast("double")))
    field = spark.read.parquet(stream).select(*CELL, "v")
    objects = staged(trackers.cyclones_z500(field, DOMAIN), "tracked")
    steps = field.agg(F.max("t")).first()[0]
    sink = spark.read.parquet(_written(spark, streams.dense(objects, field)))
    return streams.check_shape(sink.where("obj_id > 0").select(F.col("obj_id").cast("long").alias("obj_id"), "t", "iy", "ix"), (steps or 0) + 1, NY, NX)


def _by_year(rows, path, name):
    """A file for each year of ts in path/part=<name><year>."""
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("key").cast("long").alias("key")).withColumn("part", F.concat(F.lit(name), F.year("ts")))
    rows.repartition("part").sortWithinPartitions("part", "ts").write.mode("append").partitionBy("part").parquet(path)


def _archive(spark, sf_dir):
    """Orders in a file for each year, indexed; and lines by their dates."""
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("key"))
    _by_year(orders, f"{at}/files", "y")
    index, _ = sources_index.refresh(spark, f"{at}/index", sources_index.listing(spark, f"{at}/files"))
    return at, index, lines


@query("""with r as (select 'y' || year(o_orderdate) as part, o_orderdate::timestamp as ts, false as read from orders where year(o_orderdate) not in (1995, 1996)
        union all select 'y1996', l_shipdate::timestamp, true from lineitem where year(l_shipdate) = 1996 union all select 'n' || year(l_shipdate), l_shipdate::timestamp, true from lineitem where year(l_shipdate) = 2000),
    d as (select distinct part, read, ts from r), s as (select *, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by part order by ts))) / 3.6e9, 6) as d from d)
    select part, min(ts) as t0, max(ts) as t1, count(*) as n, mode(d)::double as step_h, read from s group by part, read""")
def index_refresh(spark, sf_dir):
    """A kept index after a file changed, one came and one went: only the two are read."""
    at, _, lines = _archive(spark, sf_dir)
    files, _ = file_system(spark, at)
    for gone in ("y1995", "y1996"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/files/part={gone}"), True)
    _by_year(lines.where("year(ts) = 1996"), f"{at}/files", "y")
    _by_year(lines.where("year(ts) = 2000"), f"{at}/files", "n")
    index, read = sources_index.refresh(spark, f"{at}/index", sources_index.listing(spark, f"{at}/files"))
    new = spark.createDataFrame([(x,) for x in read], "path string").withColumn("read", F.lit(True))
    out = index.join(new, "path", "left").withColumn("part", F.regexp_extract("path", "part=([a-z0-9]+)", 1))
    return out.select("part", F.col("t0").cast("timestamp_ntz").alias("t0"), F.col("t1").cast("timestamp_ntz").alias("t1"), "n", "step_h", F.coalesce("read", F.lit(False)).alias("read"))


@query("select o_orderkey as key, o_orderdate::timestamp as ts from orders where o_orderdate >= timestamp '1995-01-01' - interval 48 hours and o_orderdate < timestamp '1996-01-01' + interval 48 hours")
def year_files_scan(spark, sf_dir):
    """A year with its halo from the files that the index gives for it."""
    _, index, _ = _archive(spark, sf_dir)
    return sources_index.open_year(spark, index, 1995, 48).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""with {FIELD}, z as (select (t // 100)::int as segment, t, iy, ix, (53000 + 12000 * v)::float::double as z, v::float::double as w from f)
    select 'z500' as stream, segment, t, iy, ix, z as v from z union all select 'wind', segment, t, iy, ix, w from z""")
def canonical_sink(spark, sf_dir):
    """Two streams prepared twice, the second time with other values, of which nothing is written: each segment stays as it was."""
    f = dense(spark, sf_dir).withColumn("segment", F.floor(F.col("t") / 100).cast("int"))
    at = f"{shared_dir(spark)}/canonical-{uuid.uuid4().hex}"
    z = f.select(*CELL, (53000 + 12000 * F.col("v").cast("double")).alias("v"))
    sinks.prepare({"z500": z, "wind": f.select(*CELL, "v")}, at)
    sinks.prepare({"z500": z.withColumn("v", F.lit(0.0)), "wind": f.select(*CELL, "v")}, at)
    return spark.read.parquet(at).select("stream", "segment", "t", "iy", "ix", F.col("v").cast("double").alias("v"))


@query(f"{OBJECTS}, s as (select (t // 100)::int as segment, obj as obj_id, t, round(sum(area), 0) as area from l join ga using (iy, ix) group by all) select 'cells' as tracker, segment, obj_id, t, area from s")
def statistics_sink(spark, sf_dir):
    at = f"{shared_dir(spark)}/statistics-{uuid.uuid4().hex}"
    stats = objects.areas(found(spark, sf_dir), full_grid(spark)).withColumn("segment", F.floor(F.col("t") / 100).cast("int"))
    for _ in range(2):  # the second replaces the first
        sinks.write_statistics(stats, at, "cells")
    return rounded(spark.read.parquet(at), "area", places=0).select("tracker", "segment", "obj_id", "t", "area")


@query("""with y as (select distinct year(o_orderdate)::int as year, 'orders' as stream from orders union all select distinct year(l_shipdate)::int, 'lines' from lineitem union all select distinct year(ts)::int, 'events' from events)
    select year, string_agg(stream, ',' order by stream) as streams from y group by year""")
def years_of_streams(spark, sf_dir):
    stamps = {"orders": ("orders", "o_orderdate"), "lines": ("lineitem", "l_shipdate"), "events": ("events", "ts")}
    # Each day stands for a file.
    index = {n: table(spark, sf_dir, t).groupBy(F.to_date(c)).agg(F.min(c).alias("t0"), F.max(c).alias("t1")) for n, (t, c) in stamps.items()}
    return streams.years_of_streams(**index).select("year", F.array_join("streams", ",").alias("streams"))


@query(f"with {FIELD} select distinct (t // 100)::int as segment from f where t >= 200")
def missing_segments(spark, sf_dir):
    f = dense(spark, sf_dir).withColumn("segment", F.floor(F.col("t") / 100).cast("int"))
    path = _written(spark, f.where("t < 200"))
    return streams.missing_segments(f.select("segment").distinct(), spark, path)


@query(f"{WITH} select obj as obj_id, t, iy, ix from l")
def read_back(spark, sf_dir):
    objects = spark.read.parquet(_written(spark, found(spark, sf_dir)))
    n = dense(spark, sf_dir).agg(F.max("t")).first()[0] + 1
    return streams.check_shape(objects, n, NY, NX).select("obj_id", "t", "iy", "ix")


@query("select extract(year from l_shipdate)::int as segment, count(*) as n, min(l_shipdate) as first from lineitem group by all")
def compact_months(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("segment"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("t"), F.col("l_orderkey").alias("iy"), F.col("l_linenumber").alias("ix"), "l_shipdate")
    return streams.compact(rows).groupBy("segment").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"))


@query(f"with {FIELD} select t, iy, ix, v as z from f")
def map_columns(spark, sf_dir):
    rows = streams.squeeze(dense(spark, sf_dir).withColumn("level", F.lit(500)), "level")
    return streams.map_columns(rows, {"z": "v", "q": "absent"})[0].drop("segment")


@query(f"with {GRID} select iy, ix, lat, lon from g")
def grid_load(spark, sf_dir):
    return used_grid(spark, sf_dir).select("iy", "ix", "lat", "lon")


@query("""select floor(datediff('day', date '1995-01-01', l_shipdate::date) / 7.0)::int as t, (l_suppkey % 40)::int as iy, (l_partkey % 50)::int as ix, round(sum(l_extendedprice * (1 - l_discount)), 4) as v from lineitem group by all""")
def large_field(spark, sf_dir):
    return rounded(fields.from_lines(table(spark, sf_dir, "lineitem")).drop("segment"), "v", places=4)


@query(f"""with {HOURLY}, w as (select segment, hour_idx // 6 * 6 as s, iy, ix, sum(v) as total, max(v) as peak, count(*) as n from h group by all having count(*) >= 1), k as (select distinct segment, hour_idx // 6 * 6 as hour_idx, iy, ix from h),
    q as (select k.hour_idx, k.iy, k.ix, coalesce(total, 0) as total, coalesce(peak, 0) as peak from k left join (select * from w where n = 6) w on w.s = k.hour_idx and w.iy = k.iy and w.ix = k.ix) select hour_idx, iy, ix, round(total, 6) as total, round(peak, 6) as peak from q""")
def load_precipitation(spark, sf_dir):
    h = hourly(spark, sf_dir)
    times = h.select("segment", (F.floor(F.col("hour_idx") / 6) * 6).cast("long").alias("hour_idx"), "iy", "ix").distinct()
    return rounded(streams.load_precipitation(h, times, 6, 1, "amount").drop("segment"), "total", "peak")


@query(f"with {HOURLY} select hour_idx, iy, ix, round(v, 6) as v from h where hour_idx % 6 = 0")
def load_stream(spark, sf_dir):
    return rounded(streams.load_stream(hourly(spark, sf_dir), 6, 1).drop("segment"), "v")


# ---- B: time axis


_STEPS = """with s as (select distinct user_id::int as segment, (floor((epoch_us(ts) - 1704067200000000) / 3.6e9))::bigint as hour_idx from events), d as (select segment, (hour_idx - lag(hour_idx) over (partition by segment order by hour_idx))::double as d from s),
    c as (select segment, d, count(*) as n from d where d is not null group by segment, d)"""


def _ragged(spark, sf_dir):
    """The hours in which each user has an event."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("segment"), hour.alias("hour_idx")).distinct()


@query(f"{_STEPS} select segment, d as step_h, n from c")
def step_differences(spark, sf_dir):
    return timeaxis.step_counts(_ragged(spark, sf_dir))


@query(f"{_STEPS} select segment, arg_max(d, (n, -d)) as step_h, count(*) = 1 as regular from c group by segment")
def dominant_step(spark, sf_dir):
    return timeaxis.dominant_step(_ragged(spark, sf_dir))


@query(f"with {HOURLY} select distinct hour_idx, hour_idx % 6 = 0 as on_step from h")
def on_step(spark, sf_dir):
    return stamps(spark, sf_dir).select("hour_idx", timeaxis.on_step(F.col("hour_idx"), 6).alias("on_step"))


@query(f"with {HOURLY} select hour_idx, iy, ix, round(v, 6) as v from h where hour_idx % 3 = 0")
def subsample(spark, sf_dir):
    return rounded(timeaxis.subsample(hourly(spark, sf_dir), 3, 1).drop("segment"), "v")


@query(f"with {HOURLY}, s as (select hour_idx, sum(v) as v from h group by all) select hour_idx // 6 * 6 as start, round(sum(v), 4) as total, round(max(v), 4) as peak from s group by all having count(*) = 6")
def accumulate(spark, sf_dir):
    line = hourly(spark, sf_dir).groupBy("segment", "hour_idx").agg(F.sum("v").alias("v"))
    return rounded(timeaxis.accumulate(line, 6, 1, cells=("segment",)).drop("segment"), "total", "peak", places=4)


@query(f"with {HOURLY}, s as (select hour_idx, sum(v) as v from h group by all) select hour_idx // 3 * 3 as start, round(sum(v * 3600), 2) as total, round(max(v * 3600), 2) as peak from s group by all having count(*) = 3")
def accumulate_rate(spark, sf_dir):
    line = hourly(spark, sf_dir).groupBy("segment", "hour_idx").agg(F.sum("v").alias("v"))
    return rounded(timeaxis.accumulate(line, 3, 1, "rate", cells=("segment",)).drop("segment"), "total", "peak", places=2)


@query(f"with {HOURLY}, k as (select hour_idx, iy, ix from (select distinct hour_idx from h), range(10) a(iy), range(15) b(ix) where hour_idx % 24 = 0) select k.hour_idx, k.iy::int as iy, k.ix::int as ix, round(coalesce(v, 0), 6) as v from k left join h using (hour_idx, iy, ix)")
def align_fill(spark, sf_dir):
    h = hourly(spark, sf_dir)
    cells = spark.range(150).select(F.floor(F.col("id") / 15).cast("int").alias("iy"), (F.col("id") % 15).cast("int").alias("ix"))
    times = h.where("hour_idx % 24 = 0").select("segment", "hour_idx").distinct().crossJoin(F.broadcast(cells))  # 150 cells
    return rounded(timeaxis.align(times, h).drop("segment"), "v")


@query(f"""with {HOURLY}, n as (select *, lead(hour_idx) over w as nh, lead(v) over w as nv from h window w as (partition by iy, ix order by hour_idx)),
    y as (select *, unnest(range((ceil(hour_idx / 3.0) * 3)::bigint, coalesce(nh, hour_idx + 1), 3)) as stop from n),
    x as (select iy, ix, stop as hour_idx, case when stop = hour_idx then v else v + (nv - v) * (stop - hour_idx) / (nh - hour_idx) end as v from y)
    select iy, ix, hour_idx, round(v, 9) as v from x""")
def interpolate(spark, sf_dir):
    return rounded(timeaxis.interpolate(hourly(spark, sf_dir), 3).select("iy", "ix", "hour_idx", "v"), "v", places=9)


_FILES = "fl as (select 's' || (o_custkey % 20) as stream, o_orderkey::varchar as path, date_diff('day', date '1992-01-01', o_orderdate::date)::bigint * 24 as t0, date_diff('day', date '1992-01-01', o_orderdate::date)::bigint * 24 + o_orderkey % 40 as t1, 6.0::double as step_h, case when o_custkey % 20 = 3 and o_orderkey % 2 = 0 then 'noleap' else 'standard' end as calendar from orders)"


def _files(spark, sf_dir):
    t0 = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long") * 24
    k = F.col("o_custkey") % 20
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), k).alias("stream"), F.col("o_orderkey").cast("string").alias("path"), t0.alias("t0"), (t0 + F.col("o_orderkey") % 40).alias("t1"), F.lit(6.0).alias("step_h"), F.when((k == 3) & (F.col("o_orderkey") % 2 == 0), "noleap").otherwise("standard").alias("calendar"))


_GAPS = f"{_FILES}, gp as (select stream, path, case when t0 > lag(t1 + step_h) over w then 'gap' when t0 < lag(t1 + step_h) over w then 'overlap' end as note from fl window w as (partition by stream order by t0, path))"


@query(f"with {_GAPS} select * from gp where note is not null")
def file_gaps(spark, sf_dir):
    return timeaxis.file_gaps(_files(spark, sf_dir))


@query(f"with {HOURLY}, a as (select distinct hour_idx from h where iy < 5), b as (select distinct hour_idx from h where ix = 3) select coalesce(a.hour_idx, b.hour_idx) as hour_idx, case when a.hour_idx is null then 'second' else 'first' end as only_in from a full join b using (hour_idx) where a.hour_idx is null or b.hour_idx is null")
def axis_differences(spark, sf_dir):
    h = hourly(spark, sf_dir)
    return timeaxis.axis_differences(h.where("iy < 5"), h.where("ix = 3")).drop("segment")


@query(f"{_STEPS} select a.*, step_h, regular, 'standard' as calendar from (select segment, count(*) as n, min(hour_idx) as first, max(hour_idx) as last from s group by segment) a left join (select segment, arg_max(d, (n, -d)) as step_h, count(*) = 1 as regular from c group by segment) using (segment)")
def axis_summary(spark, sf_dir):
    return timeaxis.describe(_ragged(spark, sf_dir))


@query("select event_id, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9, 6) as hours from events")
def hours_between(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(timeaxis.hours_between(F.lit("2024-01-01"), F.col("ts")), 6).alias("hours"))


# ---- N: checks and canonicalisation


@query(f"""with {_GAPS}, n as (select stream, count(*) filter (where note = 'gap') as gaps, count(*) filter (where note = 'overlap') as laps from gp group by stream),
    s as (select stream, count(*) as files, min(t0) as first, max(t1) as last, count(distinct calendar) as k from fl group by stream)
    select stream, files, first, last, case when k > 1 then 'unsupported' when gaps = 0 then 'ready' else 'prepare' end as status,
    concat_ws('; ', case when k > 1 then 'several calendars' end, case when gaps > 0 then 'gaps: ' || gaps end, case when laps > 0 then 'overlaps: ' || laps end) as notes from s join n using (stream)""")
def stream_report(spark, sf_dir):
    return checks.stream_report(_files(spark, sf_dir), 6).withColumn("notes", F.array_join("notes", "; "))


_REPORT = f"""with {_GAPS}, n as (select stream, count(*) filter (where note = 'gap') as gaps from gp group by stream),
    s as (select stream, count(distinct calendar) as k from fl group by stream), r as (select stream, case when k > 1 then 'unsupported' when gaps = 0 then 'ready' else 'prepare' end as status from s join n using (stream))"""
_WORST = "arg_max(status, case status when 'ready' then 0 when 'prepare' then 1 else 2 end)"


@query(f"{_REPORT} select 'all' as streams, {_WORST} as status from r union all select 'one calendar', {_WORST} from r where stream not in (select stream from r where status = 'unsupported')")
def verdict(spark, sf_dir):
    """Over all streams, and over those that could be used."""
    reports = staged(checks.stream_report(_files(spark, sf_dir), 6), "reports")
    usable = reports.where("status <> 'unsupported'")
    return checks.overall(reports).withColumn("streams", F.lit("all")).union(checks.overall(usable).withColumn("streams", F.lit("one calendar")))


@query("""with w(stream, variable, source, optional, conversion, same) as (values ('orders', 'z', 'o_totalprice', false, 'x9.81', false), ('orders', 't', 'o_custkey', false, '+273.15', false), ('orders', 'q', 'o_humidity', false, '', true), ('orders', 'msl', 'o_orderkey', false, '', true),
        ('z850', 'q', 'l_humidity', true, '', true), ('z850', 't', 'l_quantity', false, '', true)),
    c as (select 'orders' as stream, column_name from information_schema.columns where table_name = 'orders' union all select 'z850', column_name from information_schema.columns where table_name = 'lineitem')
    select w.stream, variable, c.column_name is not null as present, case when c.column_name is null then (case when optional then 'prepare' else 'missing' end) when same then 'ready' else 'prepare' end as status, conversion from w left join c on c.stream = w.stream and c.column_name = w.source""")
def variable_report(spark, sf_dir):
    """Variables wanted of two streams: there and canonical, there in other units, missing, missing but optional."""
    o, l = (table(spark, sf_dir, x) for x in ("orders", "lineitem"))
    one = checks.variable_report(o, "orders", {"z": ("o_totalprice", "gpm"), "t": ("o_custkey", "degC"), "q": ("o_humidity", "kg kg-1"), "msl": ("o_orderkey", "Pa")}, dims=())
    return one.union(checks.variable_report(l, "z850", {"q": ("l_humidity", "kg kg-1"), "t": ("l_quantity", "K")}, dims=()))


_FACTS = """g as (select region, iy, ix, lat, lon from regions), r as (select region, max(d) <= 1e-4 as regular from (select region, max(lat) - min(lat) as d from g group by region, iy union all select region, max(lon) - min(lon) from g group by region, ix) group by region),
    c as (select region, min(lon) as lo, max(lon) as hi, count(*) as cells from g group by region),
    e as (select region, avg(lat) filter (where iy = 0) as first, avg(lat) filter (where iy = top) as last from g join (select region, max(iy) as top from g group by region) using (region) group by region),
    l as (select region, ((lon % 360) + 360) % 360 as l from g where iy = 0), q as (select region, coalesce(lead(l) over w, min(l) over (partition by region) + 360) - l as gap from l window w as (partition by region order by l)),
    p as (select region, count(*) >= 3 and min(gap) > 0 and max(gap) < 1.5 * median(gap) as closed from q group by region)"""


def _facts_sql(want):
    return f"""with k as (select n_regionkey as region, row_number() over (partition by n_regionkey order by c_custkey) - 1 as iy from customer join nation on n_nationkey = c_nationkey),
    regions as (select region, iy, ix, case region % 2 when 0 then 60 - 0.01::double * iy else 10 + 0.01::double * iy end + case region when 3 then 0.001 * ix else 0 end as lat, case region when 0 then 14.4::double * ix when 4 then 170 + 0.5::double * ix else -30 + 0.5::double * ix end as lon from k, range(25) r(ix)), {_FACTS} {want}"""


def _kinds_of_grids(spark, sf_dir):
    """A grid for each region, a row for each customer: one around the globe, one with bent rows, one over the date line, rows to the north and to the south."""
    g = _region_grids(spark, sf_dir)
    lat = F.when(F.col("region") % 2 == 0, 60 - 0.01 * F.col("iy")).otherwise(10 + 0.01 * F.col("iy")) + F.when(F.col("region") == 3, 0.001 * F.col("ix")).otherwise(0)
    lon = F.when(F.col("region") == 0, 14.4 * F.col("ix")).when(F.col("region") == 4, 170 + 0.5 * F.col("ix")).otherwise(-30 + 0.5 * F.col("ix"))
    return staged(g.select("region", "iy", "ix", lat.alias("lat"), lon.alias("lon")), "grids")


def _each(spark, sf_dir, one):
    g = _kinds_of_grids(spark, sf_dir)
    regions = sorted(r.region for r in g.select("region").distinct().collect())  # five
    return reduce(lambda a, b: a.union(b), (one(g.where(F.col("region") == r).drop("region")).withColumn("region", F.lit(r).cast("long")) for r in regions))


@query(_facts_sql("select region::bigint as region, regular, case when last > first then 1 else -1 end as direction, closed and regular as periodic from r join e using (region) join p using (region)"))
def grid_tests(spark, sf_dir):
    return _each(spark, sf_dir, lambda g: grid.is_regular(g).crossJoin(grid.lat_direction(g)).crossJoin(grid.is_periodic(g)))


@query(_facts_sql("""select region::bigint as region, 'convention' as subject, case when lo >= -180 and hi <= 180 then 'pm180' when lo >= 0 and hi <= 360 then '0..360' else 'mixed' end as found, 'pm180' as wanted,
        case when not (lo >= -180 and hi <= 180) and not (lo >= 0 and hi <= 360) then 'unsupported' when regular and not (lo >= -180 and hi <= 180) then 'prepare' else 'ready' end as status from c join r using (region)
    union all select region, 'lat_order', case when last > first then 'ascending' else 'descending' end, 'descending', case when regular and last > first then 'prepare' else 'ready' end from e join r using (region)
    union all select region, 'kind', case when regular then 'regular' else 'curvilinear' end, null, 'ready' from r
    union all select region, 'periodic', case when closed and regular then 'true' else 'false' end, null, 'ready' from p join r using (region)
    union all select region, 'dimensions', 't,iy,ix', 't,iy,ix', 'ready' from r union all select region, 'coordinates', 'lat,lon', 'lat,lon', 'ready' from r"""))
def grid_report(spark, sf_dir):
    return _each(spark, sf_dir, lambda g: checks.grid_report(g, ("t", "iy", "ix"), "pm180", "descending"))


@query("""with k as (select n_regionkey as region, row_number() over (partition by n_regionkey order by c_custkey) - 1 as iy from customer join nation on n_nationkey = c_nationkey),
    g as (select region, iy, ix, 60 - 0.01::double * iy + region % 2 as lat, -30 + 0.5::double * ix as lon from k, range(25) r(ix)),
    f as (select iy, ix, lat, lon from g where region = 0)
    select 'region' || r.region as stream, not exists (select 1 from (select * from g where region = r.region) a full join f using (iy, ix) where a.lat is null or f.lat is null or abs(a.lat - f.lat) > 1e-4 or abs(a.lon - f.lon) > 1e-4) as same_grid,
        r.region <> 3 as same_calendar from (select distinct region from k) r union all select 'repeat', true, true""")
def cross_checks(spark, sf_dir):
    """A grid for each region, a row for each of its customers, against the first one; and that one under another name."""
    g = _region_grids(spark, sf_dir)
    regions = sorted(r.region for r in g.select("region").distinct().collect())  # five
    keys = [checks.grid_key(g.where(F.col("region") == r)).select(F.lit(f"region{r}").alias("stream"), F.lit("noleap" if r == 3 else "standard").alias("calendar"), "grid_key") for r in regions]
    keys.append(keys[0].withColumn("stream", F.lit("repeat")))
    return checks.cross_checks(reduce(lambda a, b: a.union(b), keys))


def _region_grids(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    k = c.select(F.col("n_regionkey").alias("region"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_custkey")) - 1).alias("iy"))
    columns = spark.range(25).select(F.col("id").cast("int").alias("ix"))
    return k.crossJoin(F.broadcast(columns)).select("region", "iy", "ix", (60 - 0.01 * F.col("iy") + F.col("region") % 2).alias("lat"), (-30 + 0.5 * F.col("ix")).alias("lon"))


@query(f"with {FIELD} select t::bigint * 6 as hour_idx, 7 - iy as iy, ix, round(v * 9.81, 6) as v from f")
def canonicalise(spark, sf_dir):
    f = dense(spark, sf_dir).select("segment", (F.col("t").cast("long") * 6).alias("hour_idx"), "iy", "ix", F.col("v").alias("height"))
    mapping = grid.normalise(used_grid(spark, sf_dir), "pm180", "south_first")
    return rounded(checks.canonicalise(f, mapping, "z", "gpm", "height", 6, 6).select("hour_idx", "iy", "ix", "v"), "v")


# ---- O: streaming (an extension)


@query("""with w as (select time_bucket(interval 6 hours, ts) as start, (user_id % 10)::int as iy, sum(value) as total, max(value) as peak, count(*) as n from events group by all)
    select start, iy, round(total, 4) as total, peak, n from w where start + interval 6 hours <= (select max(ts) from events) - interval 1 hour""")
def accumulate_streaming(spark, sf_dir):
    """All files through a stream that ends when they are read; results are read back from its sink."""
    schema = table(spark, sf_dir, "events").schema
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events*" if sf_dir else "*").parquet(f"{sf_dir}/events.parquet*")
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("int").alias("iy"), F.col("value").alias("v"))
    out = accumulate_stream(rows, 6, cells=("iy",))
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{at}/out")
    return rounded(back.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", places=4)


@query(f"""with recursive {FIELD}, c as (select * from f where v > 0.1), {components('c', 'l', '2d8')}, o as (select b.t, a.obj as before_id, b.obj as obj_id, count(*) as n from l a join l b on b.t = a.t + 1 and a.iy = b.iy and a.ix = b.ix group by all),
    sz as (select t, obj, count(*) as size from l group by all), ch as (select * from o qualify row_number() over (partition by t, before_id order by n desc, obj_id) = 1),
    w as (select ch.* from ch join sz on sz.t = ch.t - 1 and sz.obj = ch.before_id qualify row_number() over (partition by ch.t, ch.obj_id order by size desc, before_id) = 1),
    nodes as (select distinct l.t, l.obj as node, w.before_id as parent from l left join w on w.t = l.t and w.obj_id = l.obj),
    r(t, node, root) as (select t, node, node from nodes where parent is null union all select n.t, n.node, r.root from nodes n join r on r.t = n.t - 1 and r.node = n.parent)
    select r.root as obj_id, l.t::bigint as t, l.iy, l.ix from l join r on r.t = l.t and r.node = l.obj""")
def link_streaming(spark, sf_dir):
    """Basins of all steps through a stream in several batches, each linked to the step before, which is state; the last step is closed by a row without a cell."""
    basins = staged(label.label(dense(spark, sf_dir).where("v > 0.1"), NY, NX, through_time=False), "basins")
    at = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    last = (basins.agg(F.max("t")).first()[0] or 0) + 1
    # Batches are ranges of steps: four, or as many as leave a million cells to each. All are cut in one job and put in place in their order.
    schema = "segment int, obj_id long, t int, iy int, ix int"
    n = max(4, -(-basins.count() // 1_000_000))
    batch = F.floor(F.col("t").cast("long") * n / last).cast("int")
    basins.withColumn("batch", batch).repartitionByRange(n, "batch").write.partitionBy("batch").parquet(f"{at}/cut")
    cut = spark.read.schema(f"{schema}, batch int").parquet(f"{at}/cut")
    for k in range(n):
        cut.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{at}/in")
    spark.createDataFrame([(0, None, last, None, None)], schema).write.mode("append").parquet(f"{at}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = link_stream(rows)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("segment")


# ---- M: trackers over several streams


_MCS = Mcs(pr=2.0, peak=2.5, pr_km2=1000.0, bt_km2=1000.0, rain_km2=800.0, cloud_km2=800.0, low_bt=242.0, bt=250.0, life_h=12.0, pr_h=6.0, bt_h=6.0)


def _rain(spark, sf_dir):
    f = dense(spark, sf_dir)
    return f.withColumn("v", 60 * F.col("v")), f.withColumn("v", 260 - 100 * F.col("v"))


def _large(src, out):
    return f"{out} as materialized (select {src}.* from {src} where obj in (select obj from {src} join ga using (iy, ix) group by obj, t having sum(area) >= 1e9))"


_MCS_SQL = f"""with recursive {FIELD}, {GRID}, {METRICS}, w as (select t, iy, ix, 60 * v as v from f), b as (select t, iy, ix, 260 - 100 * v as v from f),
    c as (select * from w where v >= 12), d as (select * from b where v <= 250), {components('c', 'l0')}, {components('d', 'q0')}, {_large('l0', 'l')}, {_large('q0', 'q')},
    r as (select obj, t, sum(area) as rain_area, max(v) as peak from l join ga using (iy, ix) group by all), bs as (select obj, max(peak) as best, count(*) as n from r group by obj),
    bx as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj),
    lo as (select r.obj, r.t, coalesce(min(q.v), 999) as low from r join bx using (obj) left join q on q.t = r.t and q.iy between y0 and y1 and q.ix between x0 and x1 group by all),
    pr as (select distinct l.obj, q.obj as cloud from l join q using (t, iy, ix)), ca as (select r.obj, r.t, sum(area) as cloud_area from r join pr using (obj) join q on q.obj = pr.cloud and q.t = r.t join ga on ga.iy = q.iy and ga.ix = q.ix group by all),
    hi as (select r.obj, r.t, r.t - row_number() over (partition by r.obj order by r.t) as run from r join bs using (obj) join lo using (obj, t) left join ca using (obj, t) where coalesce(cloud_area, 0) >= 8e8 and low <= 242 and rain_area >= 8e8 and peak >= 12 and best >= 15 and n >= 2),
    ke as (select distinct obj from (select obj from hi group by obj, run having count(*) >= 2)), nu as (select obj, row_number() over (order by obj) as new from (select distinct obj from l)),
    sy as materialized (select t, iy, ix, v, new from l join nu using (obj) where obj in (select obj from ke))"""


@query(f"{_MCS_SQL} select new as obj_id, t, iy, ix from sy")
def mcs_systems(spark, sf_dir):
    pr, bt = _rain(spark, sf_dir)
    return trackers.mcs(pr, bt, full_grid(spark), DOMAIN, _MCS)[1].select("obj_id", "t", "iy", "ix")


@query(f"""{_MCS_SQL}, {components('(select t, iy, ix, v from sy)', 'mg')},
    st as (select obj, t, sum(area) as size, min(v) as min, max(v) as max, avg(v) as mean, sum(v) as tot, avg(iy) as cy, avg(ix) as cx from mg join ga using (iy, ix) group by all),
    bo as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from mg group by obj),
    rd as (select st.*, least(greatest(round_even(cy - y0, 0) + y0, y0), y1)::int as iy, least(greatest(round_even(cx - x0, 0) + x0, x0), x1)::int as ix from st join bo using (obj)),
    sp as (select rd.*, case when lag(t) over w = t - 1 then sqrt(pow(cy - lag(cy) over w, 2) + pow(cx - lag(cx) over w, 2)) * 50 end as speed from rd window w as (partition by obj order by t))
    select 0 as segment, obj as obj_id, t, round(size, 0) as size, round(min, 6) as min, round(max, 6) as max, round(mean, 6) as mean, round(tot, 6) as tot, round(cy, 6) as cy, round(cx, 6) as cx, lat, lon, round(speed, 6) as speed, round(speed / 6, 6) as speed_kmh from sp join ga using (iy, ix)""")
def mcs_statistics(spark, sf_dir):
    pr, bt = _rain(spark, sf_dir)
    return rounded(trackers.mcs(pr, bt, full_grid(spark), DOMAIN, _MCS)[0], "min", "max", "mean", "tot", "cy", "cx", "speed", "speed_kmh").withColumn("size", F.round("size", 0))


def _south(spark):
    return grid.metrics(fields.regular_grid(spark, (46.0, -1.0, NY), (-12.0, 1.0, NX)))


def _lows(spark, sf_dir):
    return staged(label.label(dense(spark, sf_dir).where("v < -0.2"), NY, NX), "lows")


def _centres_sql(src, u, region):
    """CTEs for the centres of cyclones (obj, t, iy, ix) and whether a step passes the rules of a cut-off low: oks."""
    return f"""sg as (select y::int as iy, x::int as ix, 46::double - y as lat, -12::double + x as lon from range(8) a(y), range(8) b(x)), zz as (select t, iy, ix, 53000 + 12000 * v as z, {u} as u from f),
    bb as (select obj, greatest(min(iy) - 3, 0) as y0, least(max(iy) + 3, 7) as y1, greatest(min(ix) - 3, 0) as x0, least(max(ix) + 3, 7) as x1 from {src} group by obj),
    cn as (select s.obj, s.t, (arg_min(s.iy * 8 + s.ix, (z, s.iy * 8 + s.ix)) // 8)::int as cy, (arg_min(s.iy * 8 + s.ix, (z, s.iy * 8 + s.ix)) % 8)::int as cx, min(z) as low from {src} s join zz on zz.t = s.t and zz.iy = s.iy and zz.ix = s.ix group by s.obj, s.t),
    ce as (select cn.*, y0, y1, x0, x1, lat, lon, greatest(y0, cy - 3) as wy0, least(y1, cy + 3) as wy1, greatest(x0, cx - 3) as wx0, least(x1, cx + 3) as wx1 from cn join bb using (obj) join sg on sg.iy = cy and sg.ix = cx),
    ri as (select ce.obj, ce.t, count(*) as ring, count(*) filter (where zz.z - ce.low > 20 * 9.81::double) as high from ce join zz on zz.t = ce.t and zz.iy between wy0 and wy1 and zz.ix between wx0 and wx1 join sg g on g.iy = zz.iy and g.ix = zz.ix
        where abs({haversine('ce.lat', 'ce.lon', 'g.lat', 'g.lon')} - 150000) <= 200000 group by all),
    po as (select ce.obj, ce.t, count(*) as n, min(zz.u) as least from ce join zz on zz.t = ce.t and zz.ix = cx and zz.iy between wy0 and cy - 1 group by all),
    sh as (select ce.obj, ce.t, count(*) filter (where abs(s.iy - cy) <= 3 and abs(s.ix - cx) <= 3 and not (g.lat between 25 and 60 and g.lon between -29 and 19)) as stray, count(*) filter (where s.iy in (0, 7) or s.ix in (0, 7)) as border,
        (round_even(avg(s.iy) - any_value(y0), 0) + any_value(y0))::int as my, (round_even(avg(s.ix) - any_value(x0), 0) + any_value(x0))::int as mx from ce join {src} s on s.obj = ce.obj and s.t = ce.t join sg g on g.iy = s.iy and g.ix = s.ix group by ce.obj, ce.t),
    oks as (select ce.obj, ce.t, cy, cx, abs(ce.lat) between 20 and 70 and greatest(abs(46 - wy0), abs(46 - wy1)) <= 88 and stray = 0 and coalesce(high, 0) >= 0.5 * coalesce(ring, 0) and coalesce(n, 0) > 0 and coalesce(least <= 0, false) and low / 9.81 <= 9999
        and g.lon between {region[0]} and {region[1]} and g.lat between {region[2]} and {region[3]} and border = 0 as ok from ce left join ri using (obj, t) left join po using (obj, t) join sh using (obj, t) join sg g on g.iy = my and g.ix = mx)"""


_LOWS_SQL = f"with recursive {FIELD}, c as (select * from f where v < -0.2), {components('c', 'l')}"


@query(f"{_LOWS_SQL}, {split_sql('l', 2)}, {_centres_sql('so', '10 * v', (-12.0, -5.0, 39.0, 46.0))} select obj as obj_id, so.t, so.iy, so.ix from so semi join (select obj, t from oks where ok) k using (obj, t)")
def cutoff_lows(spark, sf_dir):
    z = dense(spark, sf_dir).withColumn("v", 53000 + 12000 * F.col("v"))
    u = dense(spark, sf_dir).withColumn("v", 10 * F.col("v"))
    p = CutOff(split_km=200.0, buffer_km=300.0, ring_km=150.0, ring_rise=20.0, ring_share=0.5, life_h=6.0, region=(-12.0, -5.0, 39.0, 46.0))
    return trackers.cut_off_lows(_lows(spark, sf_dir), z, u, _south(spark), trackers.Domain(NY, NX, 100_000.0), p).select("obj_id", "t", "iy", "ix")


@query(f"{_LOWS_SQL}, {_centres_sql('l', 'v', (-15.0, 10.0, 30.0, 45.0))} select obj as obj_id, t, cy as iy, cx as ix, ok from oks")
def cutoff_centres(spark, sf_dir):
    z = dense(spark, sf_dir).withColumn("v", 53000 + 12000 * F.col("v"))
    p = CutOff(split_km=200.0, buffer_km=300.0, ring_km=150.0, ring_rise=20.0, ring_share=0.5, life_h=6.0)
    return trackers.cut_off_centres(_lows(spark, sf_dir), z, dense(spark, sf_dir), _south(spark), trackers.Domain(NY, NX, 100_000.0), p).select("obj_id", "t", "iy", "ix", "ok")


_TC = Tropical(genesis_lat=80.0, warm=0.2, core=250.0, pressure=1012.0, max_lat=80.0, life_h=12.0, keep_h=6.0)


def _tropical(spark, sf_dir):
    f = dense(spark, sf_dir)
    edges = spark.createDataFrame(LAND, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    return trackers.tropical_cyclones(found(spark, sf_dir), f.withColumn("v", 275 - 40 * F.col("v")), f.withColumn("v", 101325 - 2000 * F.col("v")), full_grid(spark), DOMAIN, edges, _TC)


def _tc_sql(objects_of_field, pressure):
    return f"""{objects_of_field}, {GRID}, {_WEIGHTS}, e(poly, x1, y1, x2, y2) as (values {', '.join(map(str, LAND))}),
    big as (select obj, min(t) as t0, max(t) as t1, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj having max(t) - min(t) + 1 >= 2),
    ce as (select obj, t, arg_min(iy * 8 + ix, (({pressure}) / 100, iy * 8 + ix)) as c, min(({pressure}) / 100) as low from l where obj in (select obj from big) group by obj, t),
    co as (select ce.obj, ce.t, avg(275 - 40 * f.v) as core from ce join big using (obj) join f on f.t = ce.t and abs(f.iy - c // 8) <= 1 and abs(f.ix - c % 8) <= 1 and f.iy between y0 and y1 and f.ix between x0 and x1 group by all),
    me as (select obj, t, avg(275 - 40 * v) as mean from l group by obj, t),
    rw as (select b.obj, b.t, b.t - b.t0 as i, b.t1 - b.t0 + 1 as n, low, core, core - mean as delta, 75 - 0.5 * (c // 8) as lat, -30 + 0.5 * (c % 8) as lon
        from (select obj, t0, t1, unnest(range(t0, t1 + 1)) as t from big) b left join ce using (obj, t) left join co using (obj, t) left join me using (obj, t)),
    sm as (select a.obj, a.t, sum(k.w * s.delta) as smooth, count(s.delta) as m from rw a, k join rw s on s.obj = a.obj
        and s.i = case when ((a.i + k.d) % (2 * a.n) + 2 * a.n) % (2 * a.n) < a.n then ((a.i + k.d) % (2 * a.n) + 2 * a.n) % (2 * a.n) else 2 * a.n - 1 - ((a.i + k.d) % (2 * a.n) + 2 * a.n) % (2 * a.n) end group by a.obj, a.t),
    wa as (select rw.*, coalesce(m = 9 and smooth > 0.2, false) as warm from rw join sm using (obj, t)),
    ok as (select obj from wa group by obj having min(abs(lat)) <= 80 and count(*) filter (where warm) >= 1 and count(*) filter (where low < 1012) >= 1),
    go as (select obj, t, lat, lon, t - row_number() over (partition by obj order by t) as run from wa where obj in (select obj from ok) and warm and core > 250 and low < 1012 and abs(lat) <= 80),
    fi as (select obj, run, arg_min(lat, t) as lat, arg_min(lon, t) as lon from go group by obj, run),
    bo as (select distinct obj, run from (select obj, run, poly, count(*) as n from fi join e on ((y1 <= lat and lat < y2) or (y2 <= lat and lat < y1)) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon group by all) where n % 2 = 1),
    gd as (select * from go anti join bo using (obj, run))"""


_TC_SQL = _tc_sql(WITH, "101325 - 2000 * v")


@query(f"{_TC_SQL} select l.obj as obj_id, l.t, l.iy, l.ix from l semi join gd using (obj, t)")
def tc_objects(spark, sf_dir):
    return _tropical(spark, sf_dir)[0].select("obj_id", "t", "iy", "ix")


@query(f"{_TC_SQL} select 0 as segment, s.obj as obj_id, s.t, gd.lat, gd.lon from (select obj, unnest(range(min(t), max(t) + 1)) as t from gd group by obj) s left join gd on gd.obj = s.obj and gd.t = s.t")
def tc_tracks(spark, sf_dir):
    return _tropical(spark, sf_dir)[1]


@query(f"""with recursive {FIELD}, c as (select * from f where v > 0.2), d as (select * from f where v > 0.1 and iy < 6), {components('c', 'l')}, {components('d', 'q', '2d8')},
    {GRID}, r as (select obj, t, count(*) as cells, max(150 * v) as peak from l group by all), b as (select obj, max(peak) as best, count(*) as n from r group by obj),
    bx as (select obj, min(iy) as y0, max(iy) as y1, min(ix) as x0, max(ix) as x1 from l group by obj), lo as (select r.obj, r.t, coalesce(min(260 - 100 * q.v), 999) as low from r join bx using (obj) left join q on q.t = r.t and q.iy between y0 and y1 and q.ix between x0 and x1 group by all),
    pr as (select distinct l.obj, q.obj as cloud from l join q using (t, iy, ix)), ca as (select r.obj, r.t, count(*) as cloud_cells from r join pr using (obj) join q on q.obj = pr.cloud and q.t = r.t group by all)
    select r.obj as obj_id, r.t, coalesce(cloud_cells, 0) > 0 and low <= 240 and peak >= 30 and best >= 36 and n >= 2 as hit from r join b using (obj) join lo using (obj, t) left join ca using (obj, t)""")
def mcs_steps(spark, sf_dir):
    f = dense(spark, sf_dir)
    p = Mcs(pr=5.0, peak=6.0, rain_km2=1.0, cloud_km2=1.0, low_bt=240.0)
    return trackers.mcs_steps(found(spark, sf_dir), clouds(spark, sf_dir), f.withColumn("v", 150 * F.col("v")), f.withColumn("v", 260 - 100 * F.col("v")), full_grid(spark), DOMAIN, p).drop("segment")


# ---- M10, M11: year jobs


def _job(spark, name, streams, grid_, params=None, domain=DOMAIN):
    """A job's labels, from its output as it lies in the sink."""
    at = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    jobs.run(name, streams, grid_, domain, at, params)
    return at


def _kinds(spark, at, name, *labels):
    rows = [jobs.objects_of(at, name, x, spark).withColumn("kind", F.lit(x)) for x in labels]
    return reduce(lambda a, b: a.unionByName(b), rows).select("kind", "obj_id", "t", "iy", "ix")


def _both(low, high):
    return f"select 'cyclones' as kind, * from ({low}) union all select 'anticyclones', * from ({high})"


@query(_both(_tracker("(53000 + 12000 * v) / 9.81", "< -80", 3, 2), _tracker("(53000 + 12000 * v) / 9.81", "> 70", 3, 2)))
def year_job_z500(spark, sf_dir):
    z = _z(spark, sf_dir).select(*CELL, F.col("v").alias("z"))
    return _kinds(spark, _job(spark, "z500", {"z500": z}, full_grid(spark)), "z500", "cyclones", "anticyclones")


@query(_both(_tracker("(101325 + 10000 * v) / 100", "< -5", 3, 2), _tracker("(101325 + 10000 * v) / 100", "> 12", 3, 2)))
def year_job_slp(spark, sf_dir):
    msl = dense(spark, sf_dir).select(*CELL, (101325 + 10000 * F.col("v")).alias("msl"))
    return _kinds(spark, _job(spark, "slp", {"slp": msl}, full_grid(spark), Slp(watershed=False)), "slp", "cyclones", "anticyclones")


@query(SQL["jets"])
def year_job_jet(spark, sf_dir):
    return _kinds(spark, _job(spark, "jet", {"z200": _wind(spark, sf_dir)}, full_grid(spark), Jet(small_km=100.0)), "jet", "jets").drop("kind")


@query(SQL["rivers_flux"])
def year_job_ar850(spark, sf_dir):
    f = dense(spark, sf_dir).select(*CELL, F.col("v").alias("u"), (0.1 * F.col("v")).alias("v"), F.lit(0.6).alias("q"))
    return _kinds(spark, _job(spark, "ar850", {"z850": f}, full_grid(spark), River(area_km2=1500.0)), "ar850", "rivers").drop("kind")


@query(SQL["rivers_ivt"])
def year_job_ar_ivt(spark, sf_dir):
    f = dense(spark, sf_dir).select(*CELL, (2500 * F.col("v")).alias("ivte"), F.lit(0.0).alias("ivtn"))
    return _kinds(spark, _job(spark, "ar_ivt", {"ivt": f}, full_grid(spark)), "ar_ivt", "rivers").drop("kind")


_SLP = _tracker("(101325 + 10000 * v) / 100", "< -5", 3, 2)
_SLP_OBJECTS = f"with recursive {FIELD}, l as materialized (select q.obj_id as obj, f.* from ({_SLP}) q join f using (t, iy, ix))"


@query(f"{_tc_sql(_SLP_OBJECTS, '101325 + 10000 * v')} select l.obj as obj_id, l.t, l.iy, l.ix from l semi join gd using (obj, t)")
def year_job_tc(spark, sf_dir):
    """Surface cyclones tracked and published, tropical ones among them as they were read back."""
    msl = dense(spark, sf_dir).select(*CELL, (101325 + 10000 * F.col("v")).alias("msl"))
    warm = dense(spark, sf_dir).select(*CELL, (275 - 40 * F.col("v")).alias("temp"))
    at = _job(spark, "slp", {"slp": msl}, full_grid(spark), Slp(watershed=False))
    edges = spark.createDataFrame(LAND, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    jobs.run_tropical({"slp": msl, "z850": warm}, full_grid(spark), DOMAIN, at, edges, _TC)
    return jobs.objects_of(at, "tc", "cyclones", spark).drop("segment")


_Z100 = _tracker("(53000 + 12000 * v) / 9.81", "< -80", 1, 2, 31)


@query(f"""with recursive {FIELD}, {HOURLY}, l as materialized (select obj_id as obj, t, iy, ix from ({_Z100}) q), {split_sql('l', 2)}, {_centres_sql('so', '10 * v', (-12.0, -5.0, 39.0, 46.0))},
    cu as (select so.* from so semi join (select obj, t from oks where ok) k using (obj, t)), ra as (select (hour_idx // 6)::int as t, iy, ix, sum(v) as pr, max(v) as peak from h where iy < 8 and ix < 8 group by all having count(*) = 6)
    select f.t, f.iy, f.ix, coalesce(l.obj, 0)::int as cyclones, coalesce(cu.obj, 0)::int as cutoffs, round((53000 + 12000 * f.v)::float::double, 3) as z, round(coalesce(pr, 0)::float::double, 4) as pr, round(coalesce(peak, 0)::float::double, 4) as pr_peak
    from f left join l using (t, iy, ix) left join cu using (t, iy, ix) left join ra using (t, iy, ix) where l.obj is not null or cu.obj is not null or pr > 0""")
def cutoff_job(spark, sf_dir):
    """Cyclones, cut-off lows among them, and rain from hourly events on the cells, published; a second run writes nothing."""
    z = dense(spark, sf_dir).select(*CELL, (53000 + 12000 * F.col("v")).alias("z"))
    u = dense(spark, sf_dir).select(*CELL, (10 * F.col("v")).alias("u"))
    h = hourly(spark, sf_dir).where(f"iy < {NY} and ix < {NX}")
    rain = timeaxis.accumulate(h, 6, 1).select("segment", F.floor(F.col("start") / 6).cast("int").alias("t"), "iy", "ix", "total", "peak")
    d, g = trackers.Domain(NY, NX, 100_000.0), _south(spark)
    p = CutOff(split_km=200.0, buffer_km=300.0, ring_km=150.0, ring_rise=20.0, ring_share=0.5, life_h=6.0, region=(-12.0, -5.0, 39.0, 46.0))
    at, given = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}", {"z500": z, "z200": u, "pr": rain}
    for _ in range(2):
        jobs.run("cutoff", given, g, d, at, p, {s: g for s in given})
    return spark.read.parquet(f"{at}/tracker=cutoff").where("cutoffs > 0 or cyclones > 0 or pr > 0").select("t", "iy", "ix", "cyclones", "cutoffs", F.round(F.col("z").cast("double"), 3).alias("z"), *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("pr", "pr_peak")))
