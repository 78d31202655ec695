"""Components, seams, break-up, splits and watersheds against brute force and built cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.components import connected_components
from gridtrack.operators import forest, label, objects, split, watershed
from gridtrack.plans import trackers

NY, NX = 6, 7


def cells(spark, points, obj=None):
    if obj is None:
        return spark.createDataFrame([(0, *p) for p in points], "segment int, t int, iy int, ix int")
    return spark.createDataFrame([(0, o, *p) for o, p in zip(obj, points)], "segment int, obj_id long, t int, iy int, ix int")


def brute(points, near):
    points, out = set(points), {}
    while points:
        todo = [points.pop()]
        part = set(todo)
        while todo:
            a = todo.pop()
            for b in [b for b in points if near(a, b)]:
                points.remove(b)
                part.add(b)
                todo.append(b)
        name = min(t * NY * NX + y * NX + x for t, y, x in part)
        out |= {p: name for p in part}
    return out


def ids(df):
    return {(r.t, r.iy, r.ix): r.obj_id for r in df.collect()}


@pytest.mark.parametrize(("share", "seed"), [(0.15, 1), (0.4, 2)])
@pytest.mark.parametrize(("kind", "near"), [
    ({}, lambda a, b: max(abs(x - y) for x, y in zip(a, b)) <= 1),
    ({"through_time": False}, lambda a, b: a[0] == b[0] and max(abs(x - y) for x, y in zip(a, b)) <= 1),
    ({"through_time": False, "diagonal": False}, lambda a, b: a[0] == b[0] and sum(abs(x - y) for x, y in zip(a, b)) == 1),
    ({"periodic": True}, lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 and min(abs(a[2] - b[2]), NX - abs(a[2] - b[2])) <= 1),
])
def test_label_is_flood_fill(spark, share, seed, kind, near):
    rng = random.Random(seed)
    points = [(t, y, x) for t in range(5) for y in range(NY) for x in range(NX) if rng.random() < share]
    assert ids(label.label(cells(spark, points), NY, NX, **kind)) == brute(points, near)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_label_of_nothing(spark):
    assert label.label(cells(spark, []), NY, NX).count() == 0


def test_seam_merge_goes_along_chains(spark):
    points = [(0, 0, NX - 1), (0, 0, 0), (0, 2, 0), (1, 2, NX - 1), (1, 2, 0)]
    got = ids(label.seam_merge(cells(spark, points, [1, 2, 2, 3, 2]), NX))
    assert set(got.values()) == {1}
    step = ids(label.seam_merge(cells(spark, points, [1, 2, 2, 3, 2]), NX, per_step=True))
    assert step[0, 0, 0] == 1 and step[1, 2, NX - 1] == 2 and step[1, 2, 0] == 2


def test_lifetime_counts_steps_once(spark):
    points = [(0, 2, 2), (0, 2, 3), (2, 6, 6), (3, 6, 6)]
    o = cells(spark, points, [1, 1, 2, 2])
    assert {r.obj_id for r in objects.lifetime_filter(o, 2).collect()} == {1}
    assert {r.t for r in objects.lifetime_filter(o, 2).collect()} == {2, 3}
    assert objects.lifetime_filter(o, 1).select("obj_id").distinct().count() == 2


def _row(t, y, xs):
    return [(t, y, x) for x in xs]


def test_break_up_split_merge_and_both(spark):
    # One object whose two parts, of sizes 3 and 2, touch only at t = 2 and part again: the larger goes on, both times.
    points = []
    for t in (0, 1, 3, 4):
        points += _row(t, 0, [0, 1, 2]) + _row(t, 5, [0, 1])
    points += [(2, y, 0) for y in range(6)] + _row(2, 0, [1, 2])
    o = cells(spark, points, [1] * len(points))
    parents = {(r.t, r.part): r.parent for r in forest.part_parents(forest.parts(o, NY, NX)).collect()}
    area = NY * NX
    top, low = lambda t: t * area, lambda t: t * area + 5 * NX
    assert parents == {(0, top(0)): None, (0, low(0)): None, (1, top(1)): top(0), (1, low(1)): low(0), (2, top(2)): top(1), (3, top(3)): top(2), (3, low(3)): None, (4, top(4)): top(3), (4, low(4)): low(3)}
    got = ids(forest.break_up(o, NY, NX, 2))
    assert len(set(got.values())) == 3 and got[0, 0, 0] == got[4, 0, 0] != got[4, 5, 0]


def test_stationary_object_does_not_end(spark):
    points = [(t, y, x) for t in range(4) for y in (1, 4) for x in (1, 2)]
    got = ids(forest.break_up(cells(spark, points, [1] * len(points)), NY, NX, 1))
    assert len(set(got.values())) == 2 and len(got) == len(points)


def test_roots(spark):
    nodes = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(20)] + [(0, 50, None)], "segment int, node long, parent long")
    assert {r.node: r.root for r in forest.roots(nodes).collect()} == {i: 0 for i in range(20)} | {50: 50}


def test_claimed_basin(spark):
    before = [(0, 0, x) for x in range(4)] + [(0, 2, 0)]
    after = [(1, 0, x) for x in range(3)] + [(1, 1, 0), (1, 2, 0)]
    basins = cells(spark, before + after, [1, 1, 1, 1, 2] + [9] * 5)
    size = spark.createDataFrame([(0, 0, 1, 4.0), (0, 0, 2, 1.0), (0, 1, 9, 5.0)], "segment int, t int, obj_id long, size double")
    for claim, parent in (("largest", 1), ("last", 2)):
        assert [r.parent for r in forest.link_basins(basins, size, claim).where("node = 9").collect()] == [parent]


def reference_flood(v, marks):
    """Repeated scans instead of a heap: the met cell of the highest value, the oldest of equals, spreads next."""
    taken, met, age = dict(marks), [(-v[c], 0, c) for c in sorted(marks)], 0
    while met:
        met.remove(least := min(met))
        y, x = least[2]
        for c in [(y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x), (y - 1, x - 1), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x + 1)]:
            if c in v and c not in taken:
                age += 1
                taken[c] = taken[y, x]
                met.append((-v[c], age, c))
    return taken


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_uneven_wells_are_basins(spark, seed):
    """A deep wide well and a shallow narrow one: the border is the saddle, not half way."""
    well = lambda y, x: 10 * math.exp(-((y - 3) ** 2 + (x - 2) ** 2) / 12) + 4 * math.exp(-((y - 2) ** 2 + (x - 9) ** 2) / 2)
    r = random.Random(seed)
    shape = [(y, x) for y in range(7) for x in range(12) if (y, x) != (3, 6)]
    v = {c: well(*c) if seed is None else float(r.randint(0, 5)) for c in shape}
    marks = {(3, 2): 8, (2, 9): 33}
    o = cells(spark, [(0, *c) for c in shape], [1] * len(shape))
    m = spark.createDataFrame([(0, 0, *c, k) for c, k in marks.items()], "segment int, t int, iy int, ix int, marker long")
    field = spark.createDataFrame([(0, 0, *c, x) for c, x in v.items()], "segment int, t int, iy int, ix int, v double")
    got = {(x.iy, x.ix): x.obj_id for x in watershed.flood(o, m, field).collect()}
    assert got == reference_flood(v, marks)
    if seed is None:
        assert got[3, 5] == got[4, 6] == got[4, 7] == 8 and got[2, 8] == 33  # (4, 7) is nearer to (2, 9)


def test_cut_off_low(spark):
    """A closed low is accepted; so it is with a westward wind beyond its box, but not without one inside; too few high cells in the ring reject it."""
    ny, nx = 41, 61
    d = trackers.Domain(ny, nx, 50_000.0)
    p = trackers.CutOff()
    cell = spark.range(12 * ny * nx).select(F.lit(0).alias("segment"), F.floor(F.col("id") / (ny * nx)).cast("int").alias("t"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    grid = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix")).select("iy", "ix", (56 - 0.5 * F.col("iy")).alias("lat"), (-25 + 0.5 * F.col("ix")).alias("lon"))
    r2 = F.pow(F.col("iy") - 30, 2) + F.pow(F.col("ix") - 30, 2)
    z = cell.withColumn("v", 53000 - 3500 * F.exp(-r2 / 8))
    low = z.where("v < 52000").select("segment", F.lit(1).cast("long").alias("obj_id"), "t", "iy", "ix")
    b = int(d.cells(p.buffer_km))
    wind = lambda inside: cell.withColumn("v", F.when(F.col("iy").between(*inside), -5.0).otherwise(10.0))
    ok = lambda z, u: {x.ok for x in trackers.cut_off_centres(low, z, u, grid, d, p).collect()}
    assert ok(z, wind((30 - b, 29))) == {True}
    assert ok(z, wind((0, 30 - b - 1))) == {False}
    assert ok(z.withColumn("v", F.least("v", F.lit(49600.0))), wind((30 - b, 29))) == {False}
    # A window without any cell of the ring: the rule has nothing to object to.
    from dataclasses import replace
    assert {x.ok for x in trackers.cut_off_centres(low, z, wind((30 - b, 29)), grid, d, replace(p, ring_km=9000.0)).collect()} == {True}
    tracks = trackers.cut_off_lows(low, z, wind((30 - b, 29)), grid, d, p)
    assert tracks.count() == low.count()


def test_depths_are_distances_to_cells_of_the_grid():
    r = random.Random(4)
    for _ in range(30):
        ny, nx = r.randint(1, 9), r.randint(1, 9)
        inside = np.array([[r.random() < 0.8 for _ in range(nx)] for _ in range(ny)])
        outside = list(zip(*np.nonzero(~inside)))
        want = [[0.0 if not inside[y, x] else min((math.dist((y, x), o) for o in outside), default=math.inf) for x in range(nx)] for y in range(ny)]
        assert np.allclose(split.depths(inside), want)


def test_numbers_follow_old_ids_over_many_runs(spark):
    ids = [(s, i) for s in (0, 1) for i in (-5, 3, 1 << 20, (1 << 20) + 1, 1 << 40, (1 << 40) + 9)]
    got = label.relabel(spark.createDataFrame([(s, i, 0, 0, 0) for s, i in ids], "segment int, obj_id long, t int, iy int, ix int")).groupBy("segment").agg(F.sort_array(F.collect_list("obj_id")).alias("n")).collect()
    assert [r.n for r in got] == [[1, 2, 3, 4, 5, 6]] * 2


def test_far_parts_are_pieces_and_follow_the_nearest(spark):
    ny, nx = 4, 40
    points = [(t, 1, x + t) for t in range(3) for x in (2, 3, 25, 26)]
    got = ids(split.split_objects(cells(spark, points, [5] * len(points)), ny, nx, 10))
    assert len(set(got.values())) == 2
    assert got[0, 1, 2] == got[2, 1, 4] != got[2, 1, 27] == got[0, 1, 25]


def test_object_statistics_of_a_moving_rectangle(spark):
    points = [(t, y, x + 2 * t) for t in range(3) for y in (1, 2) for x in (0, 1)]
    o = cells(spark, points, [1] * len(points))
    field = spark.createDataFrame([(0, *p, float(p[1])) for p in points], "segment int, t int, iy int, ix int, v double")
    grid = spark.createDataFrame([(y, x, float(y), float(x), 2.0) for y in range(NY) for x in range(NX)], "iy int, ix int, lat double, lon double, area double")
    rows = objects.statistics(o, field, grid, 50_000.0, 6.0).orderBy("t").collect()
    assert [r.size for r in rows] == [8.0] * 3 and [r.mean for r in rows] == [1.5] * 3
    assert [r.cx for r in rows] == [0.5, 2.5, 4.5] and [r.speed for r in rows] == [None, 100.0, 100.0]
    assert [(r.lat, r.lon) for r in rows] == [(1.0, 0.0), (1.0, 2.0), (1.0, 4.0)]  # half-even from the corner


def test_tropical_cyclone(spark):
    ny = nx = 9
    d = trackers.Domain(ny, nx, 50_000.0)
    cell = spark.range(12 * ny * nx).select(F.lit(0).alias("segment"), F.floor(F.col("id") / (ny * nx)).cast("int").alias("t"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    r2 = F.pow(F.col("iy") - 4, 2) + F.pow(F.col("ix") - 4, 2)
    msl = cell.withColumn("v", 101000 - 5000 * F.exp(-r2 / 6))
    t850 = cell.withColumn("v", 285 + 8 * F.exp(-r2 / 2))
    grid = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix")).select("iy", "ix", (15 - 0.5 * F.col("iy")).alias("lat"), (-30 + 0.5 * F.col("ix")).alias("lon"))
    low = msl.where("v < 100000").select("segment", F.lit(1).cast("long").alias("obj_id"), "t", "iy", "ix")
    found, tracks = trackers.tropical_cyclones(low, t850, msl, grid, d)
    assert found.count() == low.count() and tracks.count() == 12
    assert {(r.lat, r.lon) for r in tracks.collect()} == {(13.0, -28.0)}
    sea = spark.createDataFrame([(1, -31.0, 10.0, -31.0, 16.0), (1, -31.0, 16.0, -20.0, 16.0), (1, -20.0, 16.0, -20.0, 10.0), (1, -20.0, 10.0, -31.0, 10.0)], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    assert trackers.tropical_cyclones(low, t850, msl, grid, d, sea)[0].count() == 0  # born on land


def test_mcs(spark):
    ny = nx = 8
    d = trackers.Domain(ny, nx, 50_000.0, dt=1.0)
    cell = spark.range(8 * ny * nx).select(F.lit(0).alias("segment"), F.floor(F.col("id") / (ny * nx)).cast("int").alias("t"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    here = F.col("iy").between(2, 4) & F.col("ix").between(2, 4) & F.col("t").between(1, 6)
    pr, bt = cell.withColumn("v", F.when(here, 20.0).otherwise(0.0)), cell.withColumn("v", F.when(here, 220.0).otherwise(280.0))
    grid = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix")).select("iy", "ix", F.lit(10.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(2.5e9).alias("area"))
    stats, found = trackers.mcs(pr, bt, grid, d)
    assert found.count() == 6 * 9 and stats.count() == 6
    assert trackers.mcs(pr, bt.withColumn("v", F.lit(280.0)), grid, d)[1].count() == 0


def test_depths_of_many_objects_at_once(spark):
    rng, rows, far = random.Random(5), [], {}
    for t in range(40):
        owner = {(y, x): rng.choice([0, 1, 1, 2]) if t else 1 for y in range(NY) for x in range(NX)}
        for o in (1, 2):
            inside = [c for c, w in owner.items() if w == o]
            rows += [(0, t, o, y, y, x) for y, x in inside]
            for y, x in inside:
                d = min((math.dist((y, x), c) for c, w in owner.items() if w != o), default=math.inf)
                far[t, o, y] = max(far.get((t, o, y), 0), d)
    cells = spark.createDataFrame(rows, "segment int, t int, obj_id long, part long, iy int, ix int")
    for block in (1, 1 << 16):
        got = {(r.t, r.obj_id, r.part): r.depth for r in split.interior(cells, NY, NX, block).collect()}
        assert got == pytest.approx(far)
    calls = split.interior(cells, NY, NX)._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in calls.split("FlatMapGroupsInPandas")[1].split("\n")[0]  # a task's call is a block of steps, not an object's step


def test_depths_take_few_calls_for_many_steps(spark):
    rows = [(0, t, 1, t, y, x) for t in range(3000) for y, x in ((1, 1), (1, 2), (2, 1), (2, 2))]
    cells = spark.createDataFrame(rows, "segment int, t int, obj_id long, part long, iy int, ix int")
    out = split.interior(cells, 8, 8)
    assert out.count() == 3000 and out.agg(F.max("depth")).first()[0] == 1.0
    assert cells.select(F.floor(F.col("t") / ((1 << 16) // 64))).distinct().count() == 3  # calls, for 3,000 objects' steps


def test_a_long_rain_object_meets_many_short_clouds_in_their_steps_only(spark):
    from gridtrack.operators import objects

    n = 60
    rain = spark.createDataFrame([(0, 1, t, 0, 0) for t in range(n)], "segment int, obj_id long, t int, iy int, ix int")
    cloud = spark.createDataFrame([(0, 100 + t, t, 0, x) for t in range(0, n, 2) for x in (0, 1)], "segment int, obj_id long, t int, iy int, ix int")
    grid = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "iy int, ix int, area double")
    out = objects.whole_cloud_area(rain, cloud, grid)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, t, 5.0) for t in range(0, n, 2)]
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest(r0" in joins  # the steps of a pair are cut to both spans before they are written out
