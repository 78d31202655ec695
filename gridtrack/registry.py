"""Registers queries with the SQL that gives the same rows, and writes the SQL parts that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The dense field of the vectors, and the grid that goes with it.
FIELD = "f as (select 0 as segment, vec_id::int as t, (k // 8)::int as iy, (k % 8)::int as ix, embedding[k + 1]::double as v from embeddings, range(64) r(k))"
GRID = "g as (select y::int as iy, x::int as ix, 75::double - 0.5::double * y as lat, -30::double + 0.5::double * x as lon from range(8) a(y), range(8) b(x))"
#: A grid with a row for each customer and a column for each nation.
TABLE_GRID = "g as (select (c_custkey - 1)::int as iy, n_nationkey::int as ix, 75.3::double - 0.0001::double * c_custkey as lat, -30::double + 0.5::double * n_nationkey as lon from customer, nation)"
HOURLY = "h as (select 0 as segment, (floor((epoch_us(ts) - 1704067200000000) / 3.6e9))::bigint as hour_idx, (user_id % 10)::int as iy, ((user_id // 10) % 15)::int as ix, sum(value) as v from events group by all)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


METRICS = f"""g1 as (select *, {haversine('lat', 'lon', 'lag(lat) over (partition by iy order by ix)', 'lag(lon) over (partition by iy order by ix)')} as w,
    {haversine('lat', 'lon', 'lag(lat) over (partition by ix order by iy)', 'lag(lon) over (partition by ix order by iy)')} as b from g),
    m as (select iy, ix, lat, lon, coalesce(w, lead(w) over (partition by iy order by ix)) as dx, coalesce(b, lead(b) over (partition by ix order by iy)) as dy from g1),
    ga as (select *, dx * dy as area from m)"""


def box(src: str, out: str, time: int, space: int, value: str = "v") -> str:
    """CTEs for the box mean, each axis a join of every cell with the mirrored cells of its window."""
    parts, last = [], src
    for axis, w, n in (("ix", space, "8"), ("iy", space, "8"), ("t", time, f"(select max(t) + 1 from {src})")):
        if w > 1:
            h = w // 2
            j = f"(((c.{axis} + o.d) % (2 * n.n) + 2 * n.n) % (2 * n.n))"
            others = [c for c in ("t", "iy", "ix") if c != axis]
            name = f"{out}_{axis}"
            parts.append(f"""{name} as (select c.segment, c.t, c.iy, c.ix, avg(s.{value}) as {value} from {last} c, range({-h}, {h + 1}) o(d), (select {n} as n) n
                join {last} s on s.segment = c.segment and {' and '.join(f's.{x} = c.{x}' for x in others)} and s.{axis} = case when {j} < n.n then {j} else 2 * n.n - 1 - {j} end group by all)""")
            last = name
    return ", ".join([*parts, f"{out} as (select * from {last})"])


def components(src: str, out: str, kind: str = "3d", key: str = "0", nx: int = 8, ny: int = 8, seam: bool = False) -> str:
    """CTEs for connected components of cells (t, iy, ix): least linear number that a cell reaches. key: cells of different keys do not touch."""
    reach = {"3d": "true", "2d8": "dt = 0", "2d4": "dt = 0 and abs(dy) + abs(dx) = 1"}[kind]
    wrap = f" or (a.iy + o.dy = b.iy and a.t + o.dt = b.t and abs(a.ix - b.ix) = {nx - 1})" if seam else ""
    return f"""{out}_n as materialized (select *, (t * {ny * nx} + iy * {nx} + ix)::bigint as id, {key} as key from {src}),
        {out}_o as (select * from (select unnest([-1, 0, 1]) as dt), (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where {reach}),
        {out}_e as materialized (select a.id as a, b.id as b from {out}_n a, {out}_o o join {out}_n b on b.key = a.key and b.t = a.t + o.dt and b.iy = a.iy + o.dy and b.ix = a.ix + o.dx
            {f"union select a.id, b.id from {out}_n a, (select distinct dt, dy from {out}_o) o join {out}_n b on b.key = a.key and b.t = a.t + o.dt and b.iy = a.iy + o.dy and abs(a.ix - b.ix) = {nx - 1}" if seam else ""}),
        {out}_r(id, m) as (select id, id from {out}_n union select e.b, r.m from {out}_r r join {out}_e e on e.a = r.id where r.m < e.b),
        {out} as materialized (select n.*, r.obj from {out}_n n join (select id, min(m) as obj from {out}_r group by id) r using (id))""" + ("" if not wrap else "")


def lifetime(src: str, out: str, n: int) -> str:
    """CTE for the lifetime filter with new ids; src has obj."""
    return f"{out} as materialized (select c.* exclude (obj), k.new as obj from {src} c join (select obj, row_number() over (order by obj) as new from {src} group by obj having max(t) - min(t) + 1 >= {n}) k using (obj))"


def break_up(src: str, out: str, n: int) -> str:
    """CTEs for the break-up along parts' trees; src: t, iy, ix, obj."""
    return f"""{components(f'(select t, iy, ix, obj as own from {src})', out + '_p', '2d8', key='own')},
        {out}_c as (select own, t, obj as part, count(*) as cells from {out}_p group by all),
        {out}_many as (select own from {out}_c group by own having count(*)::double / (max(t) - min(t) + 1) > 1.5),
        {out}_l as (select distinct a.own, a.t, a.obj as part, b.obj as q from {out}_p a join {out}_p b on a.own = b.own and b.t = a.t - 1 and a.iy = b.iy and a.ix = b.ix where a.own in (select own from {out}_many)),
        {out}_s as (select l.*, c.cells, d.cells as q_cells, count(*) over (partition by l.own, l.t, l.part) as n_pred,
            row_number() over (partition by l.own, l.t, l.q order by c.cells desc, l.part) as lead, row_number() over (partition by l.own, l.t, l.part order by d.cells desc, l.q) as rank
            from {out}_l l join {out}_c c on c.own = l.own and c.t = l.t and c.part = l.part join {out}_c d on d.own = l.own and d.t = l.t - 1 and d.part = l.q),
        {out}_f as (select own, t, part, q from {out}_s where rank = 1 and (n_pred > 1 or lead = 1)),
        {out}_t(part, root) as (select c.part, c.part from {out}_c c where c.own in (select own from {out}_many) and not exists (select 1 from {out}_f f where f.part = c.part) union all select f.part, t.root from {out}_t t join {out}_f f on f.q = t.part),
        {out}_b as (select p.t, p.iy, p.ix, p.own, t.root from {out}_p p left join {out}_t t on t.part = p.obj),
        {out}_i as (select own, root, row_number() over (order by own, root nulls first) as obj from {out}_b group by own, root),
        {out}_a as (select b.t, b.iy, b.ix, i.obj from {out}_b b join {out}_i i on i.own = b.own and i.root is not distinct from b.root),
        {lifetime(out + '_a', out, n)}"""
