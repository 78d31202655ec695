"""Time axis, grid, units and streams: exact cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.functions import calendars, geo, units
from gridtrack.operators import derive, grid, stencil, timeaxis
from gridtrack.plans import checks
from gridtrack.sources import fields, streams


def hours(spark, values, cells=1):
    return spark.createDataFrame([(0, h, c, 0, float(h)) for h in values for c in range(cells)], "segment int, hour_idx long, iy int, ix int, v double")


def test_accumulate_and_subsample(spark):
    h = hours(spark, range(1, 48), 2)
    rows = timeaxis.accumulate(h, 6, 1).where("iy = 0").orderBy("start").collect()
    assert [r.start for r in rows] == list(range(6, 48, 6))  # the first window lacks an hour
    full = timeaxis.accumulate(hours(spark, range(48)), 6, 1).orderBy("start").collect()
    assert (len(full), full[0].total, full[0].peak, full[1].start) == (8, 15.0, 5.0, 6)
    assert timeaxis.accumulate(hours(spark, range(48)), 6, 1, "rate").where("start = 0").first().total == 15 * 3600
    assert timeaxis.accumulate(hours(spark, range(47)), 6, 1).count() == 7  # a window that is not full goes
    assert [r.hour_idx for r in timeaxis.subsample(hours(spark, range(24)), 6, 1).orderBy("hour_idx").collect()] == [0, 6, 12, 18]
    with pytest.raises(ValueError, match="divisor"):
        timeaxis.subsample(h, 6, 4)


def test_step_detection(spark):
    six = [6 * i for i in range(10)]
    r = timeaxis.dominant_step(hours(spark, six)).first()
    assert (r.step_h, r.regular) == (6.0, True)
    r = timeaxis.dominant_step(hours(spark, [h for h in six if h != 24])).first()
    assert (r.step_h, r.regular) == (6.0, False)
    assert timeaxis.dominant_step(hours(spark, [5])).count() == 0


def test_noleap_and_360_day(spark):
    start = (31 + 26) * 24  # 27 February
    rows = spark.range(28).select((F.lit(start) + F.col("id") * 6).alias("h"))
    out = rows.select("h", *(c.alias(k) for k, c in calendars.parts(F.col("h"), "noleap", 2001).items())).orderBy("h").collect()
    assert (out[8].month, out[8].day, out[8].hour, out[8].year) == (3, 1, 0, 2001)
    r = spark.range(1).select(*(c.alias(k) for k, c in calendars.parts(F.lit(360 * 24 + 30 * 24 + 5), "360_day", 2001).items())).first()
    assert (r.year, r.month, r.day, r.hour) == (2002, 2, 1, 5)


def test_longitudes_and_periodicity(spark):
    r = spark.createDataFrame([(0.0,), (190.0,), (350.0,)], "x double").select(geo.to_pm180("x").alias("y")).collect()
    assert [x.y for x in r] == [0.0, -170.0, -10.0]

    def closed(lons):
        g = spark.createDataFrame([(y, x, float(y), lon) for y in range(2) for x, lon in enumerate(lons)], "iy int, ix int, lat double, lon double")
        return grid.is_periodic(g).first().periodic

    full = [2.5 * i for i in range(144)]
    assert closed(full) and closed([x - 180 for x in full])
    assert not closed(full[:50]) and not closed([*full, 360.0])


def test_box_mean_in_a_domain_smaller_than_the_window(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = 53_000 + rng.normal(size=(5, 4, 6))
    rows = [(0, t, y, x, float(a[t, y, x])) for t in range(5) for y in range(4) for x in range(6)]
    f = spark.createDataFrame(rows, "segment int, t int, iy int, ix int, v double")

    def one(b, w, axis):
        h, n = w // 2, b.shape[axis]
        at = [(j if j < n else 2 * n - 1 - j) for j in (i % (2 * n) for i in range(-h, n + h))]
        c = np.take(b, at, axis)
        return np.stack([np.take(c, range(i, i + w), axis).mean(axis) for i in range(n)], axis)

    want = one(one(one(a, 61, 2), 61, 1), 13, 0)
    got = {(r.t, r.iy, r.ix): r.v for r in stencil.box_mean(f, 13, 60).collect()}
    assert max(abs(got[t, y, x] - want[t, y, x]) for t in range(5) for y in range(4) for x in range(6)) < 1e-8


def test_odd_window():
    assert [stencil.odd_window(x) for x in (0, 1, 1.2, 2, 3, 60, 61)] == [1, 1, 3, 3, 3, 61, 61]


def test_units(spark):
    rows = spark.createDataFrame([("msl", "hPa", 1013.25), ("t", "degC", 5.0), ("q", "g kg-1", 5.0), ("z", "m", 5400 / 9.81), ("tp", "kg m**-2 s**-1", 2.0), ("t", "parsec", 1.0)], "var_class string, unit string, v double")
    out = {(r.var_class, r.unit): r for r in units.convert(units.lookup(rows), "v", "x").collect()}
    assert abs(out["msl", "hPa"].x - 101325) < 1e-6 and abs(out["t", "degC"].x - 278.15) < 1e-9 and abs(out["q", "g kg-1"].x - 0.005) < 1e-12
    assert abs(out["z", "m"].x - 5400) < 1e-9 and out["tp", "kg m**-2 s**-1"].kind == "rate" and out["t", "parsec"].x is None


def test_streams(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        streams.scan(spark, str(tmp_path / "absent"))
    f = hours(spark, range(12)).withColumn("t", F.col("hour_idx").cast("int")).withColumn("segment", F.floor(F.col("t") / 6).cast("int"))
    streams.write_segments(f, str(tmp_path / "s"))
    streams.write_segments(f.where("segment = 1").withColumn("v", F.lit(-1.0)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.segment: r.n for r in back.groupBy("segment").agg(F.sum("v").alias("n")).collect()} == {0: 15.0, 1: -6.0}
    wanted = spark.createDataFrame([(0,), (5,)], "segment int")
    assert [r.segment for r in streams.missing_segments(wanted, spark, str(tmp_path / "s")).collect()] == [5]
    with pytest.raises(ValueError, match="reach"):
        streams.check_shape(back.withColumn("obj_id", F.lit(1)), 5, 2, 2)


def test_canonicalise_refuses_what_it_cannot_do(spark):
    g = fields.regular_grid(spark, (50.0, -1.0, 2), (0.0, 1.0, 2))
    mapping = grid.normalise(g)
    h = hours(spark, [0, 12, 24])
    with pytest.raises(ValueError, match="no conversion"):
        checks.canonicalise(h, mapping, "z", "furlong", "v", 6, 12)
    with pytest.raises(ValueError, match="longer"):
        checks.canonicalise(h, mapping, "z", "m", "v", 6, 12)
    rows = checks.canonicalise(h, mapping, "z", "m", "v", 6, 12, may_interpolate=True).orderBy("hour_idx").collect()
    assert [round(r.v / 9.81, 6) for r in rows] == [0, 6, 12, 18, 24]


def test_longitudes_in_range_keep_their_digits(spark):
    x = [-30.4 + 0.18 * n for n in range(25)] + [-180.0, 179.9]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", geo.to_pm180("x").alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == x


def test_land_sql_states_the_query_rule_in_doubles():
    import duckdb

    from gridtrack import queries

    c = duckdb.connect()
    kinds = c.execute(f"with {queries._EDGES} select distinct typeof(x1), typeof(y1), typeof(x2), typeof(y2) from e").fetchall()
    assert kinds == [("DOUBLE",) * 4]


def test_box_mean_folds_wide_windows_and_cuts_time_into_blocks(spark):
    rng, (nt, ny, nx) = np.random.default_rng(3), (40, 5, 7)
    v = 53_000 + rng.normal(size=(nt, ny, nx))
    f = spark.createDataFrame([(0, t, y, x, float(v[t, y, x])) for t in range(nt) for y in range(ny) for x in range(nx)], "segment int, t int, iy int, ix int, v double")

    def mean(a, axis, w):
        at = np.pad(np.arange(a.shape[axis]), w // 2, "symmetric")
        return sum(np.take(a, at[k : k + a.shape[axis]], axis) for k in range(w)) / w

    for space in (1, 3, 5, 9, 11, 13, 15, 21, 61, 101):
        got = stencil.box_mean(f, 3, space, shape=(ny, nx))
        want = mean(mean(mean(v, 2, space), 1, space), 0, 3)
        assert all(abs(r.v - want[r.t, r.iy, r.ix]) < 1e-7 for r in got.collect())
        assert stencil.folded(space, nx)[0] < nx  # padding does not grow with the window
    last = f.withColumn("__n", F.lit(nt).cast("long"))
    got = {(r.t, r.iy, r.ix): r.v for r in stencil._box_axis(last, "t", 13, ["v"], False, block=1).collect()}
    want = mean(v, 0, 13)
    assert len(got) == v.size and all(abs(x - want[c]) < 1e-7 for c, x in got.items())
    keys = stencil.box_mean(f, 13, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in keys.split("Window ")[1].split("\n")[0]  # a task has a block of steps, not a cell's whole series


def test_box_means_are_of_the_values_that_are_there_in_one_exchange(spark):
    rng, (nt, ny, nx) = np.random.default_rng(5), (40, 3, 4)
    v = 53_000 + rng.normal(size=(nt, ny, nx))
    gone = {(7, y, x) for y in range(ny) for x in range(nx)} | {(0, 0, 1)}  # a step without cells, and a null
    rows = [(0, t, y, x, None if t == 0 and (t, y, x) in gone else float(v[t, y, x])) for t in range(nt) if t != 7 for y in range(ny) for x in range(nx)]
    f = spark.createDataFrame(rows, "segment int, t int, iy int, ix int, v double")

    def mean(a, axis, w):
        at = np.pad(np.arange(a.shape[axis]), w // 2, "symmetric")
        return np.nanmean([np.take(a, at[k : k + a.shape[axis]], axis) for k in range(w)], 0)

    holes = v.copy()
    for c in gone:
        holes[c] = np.nan
    with np.testing.suppress_warnings() as quiet:
        quiet.filter(RuntimeWarning)
        for space in (1, 3, 9):
            want = mean(mean(mean(holes, 2, space), 1, space), 0, 5)
            got = stencil.box_means(f, {"a": (1, 1), "b": (5, space)}, (ny, nx), block_cells=20 * ny * nx)
            assert all(abs(r.b - want[r.t, r.iy, r.ix]) < 1e-7 and (r.a is None) == ((r.t, r.iy, r.ix) in gone) for r in got.collect())
            assert got.count() == len(rows)
            assert all(abs(r.v - want[r.t, r.iy, r.ix]) < 1e-7 for r in stencil.box_mean(f, 5, space, shape=(ny, nx)).collect())
    plan = derive.anomaly(f, 1, 5, 9, shape=(ny, nx))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1  # the segments' numbers of steps
    with pytest.raises(Exception, match="a line along iy"):
        stencil.box_mean(f, 5, 3, shape=(ny + 1, nx)).collect()


def test_labels_and_splits_read_their_cells_once(spark, monkeypatch):
    from gridtrack.operators import forest, label, split
    from gridtrack.storage import staged

    names = []
    for module in (label, forest, split):
        monkeypatch.setattr(module, "staged", lambda df, name, **k: names.append(name) or staged(df, name, **k))
    cells = spark.createDataFrame([(0, t, 0, x) for t in range(3) for x in (0, 1, 1, 3)], "segment int, t int, iy int, ix int")
    got = label.label(cells, 2, 5)
    assert sorted(tuple(r) for r in got.collect()) == sorted((0, 3 * (x == 3), t, 0, x) for t in range(3) for x in (0, 1, 3))
    assert names[0] == "runs"
    split.split_objects(got, 2, 5, 1.0)
    assert "regions" in names and "pieces" in names
