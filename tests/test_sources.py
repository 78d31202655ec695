"""Kept index, publishing sinks, linking on a stream, and labelling in blocks: reads, restarts and killed runs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrack.operators import forest, grid, label, split, stencil
from gridtrack.plans import checks, config, jobs, trackers
from gridtrack.sources import buckets, fields, index, sinks, streams
from gridtrack.storage import file_system
from gridtrack.streaming import linking

BASINS = "segment int, obj_id long, t int, iy int, ix int"


def _file(spark, at, name, first, days, step_h=24):
    rows = spark.range(days * 24 // step_h).select((F.timestamp_seconds(F.unix_timestamp(F.lit(f"{first} 00:00:00")) + F.col("id") * 3600 * step_h)).alias("ts"), F.col("id").alias("k"))
    rows.coalesce(1).write.parquet(f"{at}/{name}")


@pytest.fixture
def archive(spark, tmp_path):
    at = str(tmp_path / "files")
    for y in (2000, 2001, 2002):
        _file(spark, at, f"year={y}", f"{y}-01-01", 365 + (y == 2000), 6)
    _file(spark, at, "two years=x", "2003-01-01", 365 + 366, 6)
    return at


def test_kept_index(spark, tmp_path, archive):
    kept = str(tmp_path / "index")
    assert index.read_index(spark, kept) is None
    first, read = index.refresh(spark, kept, index.listing(spark, archive))
    assert len(read) == 4 and first.where("step_h = 6.0").count() == 4
    again, read = index.refresh(spark, kept, index.listing(spark, archive))
    assert read == [] and again.count() == 4 and index._versions(spark, kept) == [1]
    fs, _ = file_system(spark, archive)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(path(f"{archive}/year=2001"), True)
    fs.delete(path(f"{archive}/year=2002"), True)
    _file(spark, archive, "year=2002", "2002-01-01", 10)
    _file(spark, archive, "year=2009", "2009-05-01", 3)
    third, read = index.refresh(spark, kept, index.listing(spark, archive))
    assert sorted(p.split("year=")[1][:4] for p in read) == ["2002", "2009"]
    years = {r.path.split("/files/")[1].split("/")[0]: (r.n, r.step_h) for r in third.collect()}
    assert years == {"year=2000": (366 * 4, 6.0), "year=2002": (10, 24.0), "year=2009": (3, 24.0), "two%20years=x": (731 * 4, 6.0)}
    _, read = index.refresh(spark, kept, index.listing(spark, archive), reindex=True)
    assert len(read) == 4 and index._versions(spark, kept) == [2, 3]
    assert [r.year for r in streams.available_years(third).collect()] == [2000, 2002, 2003, 2004, 2009]


def test_only_files_of_the_year_are_read(spark, tmp_path, archive):
    entries, _ = index.refresh(spark, str(tmp_path / "index"), index.listing(spark, archive))
    for year, halo, names in ((2001, 0, ["year=2001"]), (2004, 0, ["two years=x"]), (2001, 48, ["year=2000", "year=2001", "year=2002"])):
        rows = index.open_year(spark, entries, year, halo)
        assert sorted({f.replace("%20", " ").split("/files/")[1].split("/")[0] for f in rows.inputFiles()}) == names
        assert len(rows.inputFiles()) == len(index.year_files(entries, year, halo)) == len(names)
    assert index.open_year(spark, entries, 2004).count() == 366 * 4
    assert index.open_year(spark, entries, 2001, 48).count() == (365 + 4) * 4
    with pytest.raises(FileNotFoundError, match="2000 to 2004"):
        index.open_year(spark, entries, 2010)


def field(spark, value=1.0, segments=(2000, 2001)):
    return spark.createDataFrame([(s, t, y, x, value + t) for s in segments for t in range(3) for y in range(2) for x in range(2)], "segment int, t int, iy int, ix int, v double")


def test_parts_are_published_whole(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "out")
    assert sinks.prepare({"z500": field(spark), "slp": field(spark, segments=(2000,))}, at) == {"z500": [2000, 2001], "slp": [2000]}
    rows = spark.read.parquet(at)
    assert rows.schema["v"].dataType.simpleString() == "float" and rows.count() == 36
    # What is there stays; a new segment is added; force replaces.
    assert sinks.prepare({"z500": field(spark, 5.0, (2000, 2001, 2002))}, at) == {"z500": [2002]}
    means = lambda: {r.segment: r.v for r in spark.read.parquet(at).where("stream = 'z500'").groupBy("segment").agg(F.min("v").alias("v")).collect()}
    assert means() == {2000: 1.0, 2001: 1.0, 2002: 5.0}
    assert sinks.prepare({"z500": field(spark, 7.0, (2001,))}, at, force=True) == {"z500": [2001]}
    assert means() == {2000: 1.0, 2001: 7.0, 2002: 5.0}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_a_run_that_ends_early_leaves_no_half_part(spark, tmp_path):
    at = str(tmp_path / "out")
    bad = field(spark).withColumn("v", F.when((F.col("segment") == 2001) & (F.col("t") == 2), F.raise_error(F.lit("ends here")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="ends here"):
        sinks.publish(bad, at, "z500")
    assert not list((tmp_path / "out").glob("stream=*/segment=*")) and not list((tmp_path / "out").glob("_*"))
    # The folder that a killed driver could not take away is no part either.
    field(spark).write.partitionBy("segment").parquet(f"{at}/_part-left")
    assert sinks.publish(field(spark), at, "z500") == [2000, 2001] and spark.read.parquet(at).count() == 24


@pytest.mark.parametrize("claim", ["largest", "last"])
def test_stream_links_are_the_batch_links(spark, tmp_path, claim):
    rng = random.Random(3)
    points = [(s, t, y, x) for s in (0, 1) for t in range(14) for y in range(9) for x in range(9) if rng.random() < 0.45 and (s, t) != (0, 6)]
    cells = spark.createDataFrame(points, "segment int, t int, iy int, ix int")
    basins = label.label(cells, 9, 9, through_time=False, diagonal=False).cache()
    sizes = basins.groupBy("segment", "t", "obj_id").agg(F.count("*").alias("size"))
    want = {tuple(r) for r in forest.track(basins, forest.link_basins(basins, sizes, claim)).select("segment", "obj_id", "t", "iy", "ix").collect()}
    at = str(tmp_path)

    def add(rows):
        rows.coalesce(1).write.mode("append").parquet(f"{at}/in")

    def run():
        rows = spark.readStream.schema(BASINS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        linking.link_stream(rows, claim).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return {tuple(r) for r in spark.read.parquet(f"{at}/out").select("segment", "obj_id", "t", "iy", "ix").collect()}

    # A step in two batches, then a stop, then the rest from the checkpoint.
    add(basins.where("t < 5 or t = 5 and iy < 4"))
    add(basins.where("t = 5 and iy >= 4"))
    assert run() == {r for r in want if r[2] < 5}
    add(basins.where("t between 6 and 9"))
    assert max(r[2] for r in run()) == 8
    add(basins.where("t > 9"))
    add(spark.createDataFrame([(s, None, 14, None, None) for s in (0, 1)], BASINS))
    assert run() == want


def test_a_late_step_is_an_error(spark, tmp_path):
    schema = "segment int, obj_id long, t int, iy int, ix int"
    for t in (3, 2):
        spark.createDataFrame([(0, 1, t, 0, 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="step 2 came after step 3"):
        linking.link_stream(rows).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def test_touching_runs_are_linear(spark):
    nx = 1440
    cells = spark.range(4 * nx).select(F.lit(0).alias("segment"), F.lit(0).alias("t"), F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix")).where("(iy + ix) % 2 = 0")
    runs = label.runs(cells, 4, nx)
    moved = runs.withColumn("iy", F.col("iy") + 1)
    n = label.touching(moved, runs, ["segment", "t", "iy"], 1).count()
    assert n == 3 * (nx - 1)  # each run of one cell touches two of the next row, but for the ends
    assert label.touching(moved, runs, ["segment", "t", "iy"], 0).count() == 0
    assert label.label(cells, 4, nx).select("obj_id").distinct().count() == 1


@pytest.mark.parametrize("block", [1, 200, 1 << 18])
def test_components_in_blocks(spark, block):
    rng = random.Random(block)
    nodes = [(s << 44) + k for s in (0, 3) for k in range(0, 4000, 7)]
    edges = [(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(500)) if a >> 44 == b >> 44]
    edges += [(nodes[k], nodes[k + 1]) for k in range(80)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in label.components(spark.createDataFrame(edges, "a long, b long"), 10, 10, block).collect()}
    assert got == {n: find(n) for n in up}


def test_streams_side_by_side_need_no_exchange(spark):
    cells = spark.range(4000).select(F.lit(0).alias("segment"), (F.col("id") / 100).cast("int").alias("t"), (F.col("id") % 100 / 10).cast("int").alias("iy"), (F.col("id") % 10).cast("int").alias("ix"), F.col("id").cast("double").alias("v"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        buckets.colocated(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        a, b = buckets.bucketed(cells, 5), buckets.bucketed(cells.withColumnRenamed("v", "w").where("iy < 7"), 5)
        both = a.join(b, ["segment", "t", "iy", "ix"])
        steps = both.groupBy("segment", "t").agg(F.sum(F.col("v") - F.col("w")).alias("d"), F.count("*").alias("n"))
        left = streams.dense(b.withColumnRenamed("w", "obj_id"), a)
        for df in (both, steps, left):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert [(r.d, r.n) for r in steps.collect()] == [(0.0, 70)] * 40 and left.count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_depth_is_linear_and_exact():
    rng = np.random.default_rng(4)
    for shape, share in (((9, 13), 0.7), ((30, 5), 0.95), ((1, 8), 0.5), ((12, 1), 0.8), ((20, 20), 0.999)):
        for _ in range(20):
            inside = rng.random(shape) < share
            out = np.argwhere(~inside)
            want = np.array([[np.sqrt(((out - (y, x)) ** 2).sum(axis=1).min()) if len(out) else np.inf for x in range(shape[1])] for y in range(shape[0])])
            assert np.allclose(split.depths(inside), want)
    big = np.zeros((1002, 1002), bool)
    big[1:-1, 1:-1] = True
    began = time.time()
    assert split.depths(big).max() == 500.0 and time.time() - began < 10


def test_peaks_are_thinned_from_the_highest(spark):
    rng = random.Random(5)
    field = [(0, 0, y, x, float(rng.randint(0, 9))) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(field, "segment int, t int, iy int, ix int, v double")
    labels = df.select("segment", "t", "iy", "ix", F.when(F.col("ix") < 10, 1).otherwise(2).cast("long").alias("obj_id"))
    v = {(y, x): z for _, _, y, x, z in field}
    for d in (1, 3):
        want = set()
        for lo in (0, 10):
            top = [(y, x) for y, x in v if lo <= x < lo + 10 and v[y, x] > 2 and d <= y < 20 - d and d <= x < 20 - d and v[y, x] == max(v.get((y + i, x + j), -1) for i in (-1, 0, 1) for j in (-1, 0, 1))]
            kept = []
            for c in sorted(top, key=lambda c: (-v[c], c)):
                if all(max(abs(c[0] - k[0]), abs(c[1] - k[1])) > d for k in kept):
                    kept.append(c)
            want |= set(kept)
        out = stencil.peaks(df, labels, d, 2.0, 20, 20)
        assert {(r.iy, r.ix) for r in out.collect()} == want and want
        assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_land_mask_is_the_point_test(spark):
    rng = random.Random(6)
    edges = []
    for k in range(6):
        cx, cy = rng.uniform(-20, 20), rng.uniform(-10, 10)
        ring = [(cx + rng.uniform(2, 9) * math.cos(a), cy + rng.uniform(2, 9) * math.sin(a)) for a in [i * 0.7 for i in range(9)]]
        edges += [(k, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    edges = spark.createDataFrame(edges, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    g = spark.range(60 * 80).select((F.col("id") / 80).cast("int").alias("iy"), (F.col("id") % 80).cast("int").alias("ix"))
    g = g.select("iy", "ix", (-15 + 0.5 * F.col("iy")).alias("lat"), (360 - 30 + 0.75 * F.col("ix")).alias("lon"))
    rows = lambda df: sorted((r.iy, r.ix, r.land) for r in df.collect())
    got = rows(grid.land_mask(g, edges))
    assert got == rows(grid.on_land(g, edges, ["iy", "ix"])) and 100 < sum(x[2] for x in got) < 4700


def test_year_jobs_check_their_streams(spark, tmp_path):
    rng = random.Random(9)
    g = grid.metrics(fields.regular_grid(spark, (50.0, -0.5, 6), (0.0, 0.5, 6)))
    d = jobs.Domain(6, 6, 50_000.0)

    def stream(column, steps=8, segments=(2000, 2001)):
        return spark.createDataFrame([(s, t, y, x, rng.uniform(0, 900)) for s in segments for t in range(steps) for y in range(6) for x in range(6)], f"segment int, t int, iy int, ix int, {column} double")

    at = str(tmp_path / "out")
    ivt = stream("ivte").withColumn("ivtn", F.lit(0.0))
    first = ivt.where("segment = 2000")
    assert jobs.run("ar_ivt", {"ivt": first}, g, d, at) == [2000]
    assert jobs.run("ar_ivt", {"ivt": ivt}, g, d, at) == [2001] and jobs.run("ar_ivt", {"ivt": ivt}, g, d, at) == []
    assert jobs.run("ar_ivt", {"ivt": ivt}, g, d, at, force=True) == [2000, 2001]
    rows = spark.read.parquet(f"{at}/tracker=ar_ivt")
    assert rows.count() == ivt.count() and dict(rows.dtypes)["ivt"] == "float" and dict(rows.dtypes)["rivers"] == "int"
    # Both segments in one run are the segments one by one.
    both = {tuple(r) for r in jobs.objects_of(at, "ar_ivt", "rivers", spark).collect()}
    alone = str(tmp_path / "alone")
    for s in (2000, 2001):
        jobs.run("ar_ivt", {"ivt": ivt.where(F.col("segment") == s)}, g, d, alone)
    assert both == {tuple(r) for r in jobs.objects_of(alone, "ar_ivt", "rivers", spark).collect()} and both
    z, u, pr = stream("z"), stream("u"), stream("total", 5).withColumn("peak", F.lit(0.0))
    with pytest.raises(ValueError, match="z200 has other steps than z500: segment 200[01], step 7"):
        jobs.run("cutoff", {"z500": z, "z200": u.where("t < 7"), "pr": pr}, g, d, at)
    other = g.withColumn("lat", F.col("lat") + 0.1)
    with pytest.raises(ValueError, match="z200 has another grid"):
        jobs.run("cutoff", {"z500": z, "z200": u, "pr": pr}, g, d, at, grids={"z500": g, "z200": other, "pr": g})
    jobs.run("slp", {"slp": stream("msl", 8)}, g, d, at, config.Slp(watershed=False))
    with pytest.raises(ValueError, match="track them again"):
        jobs.run_tropical({"slp": stream("msl", 9), "z850": stream("temp", 9)}, g, d, at)


@pytest.mark.parametrize("turn", ["flipped", "full circle", "curvilinear"])
def test_trackers_on_turned_grids(spark, turn):
    """Rows turned round, longitudes from 0 to 360 and bent coordinates: the same objects, cell by cell."""
    rng = random.Random(10)
    ny = nx = 10
    msl = spark.createDataFrame([(0, t, y, x, 101000 + rng.gauss(0, 1500)) for t in range(6) for y in range(ny) for x in range(nx)], "segment int, t int, iy int, ix int, v double").cache()
    g = fields.regular_grid(spark, (70.0, -0.5, ny), (-2.0, 0.5, nx))
    d = jobs.Domain(ny, nx, 50_000.0)
    p = config.Slp(watershed=False)
    shape = lambda df: {frozenset((r.t, r.iy, r.ix) for r in part) for part in _by_object(df)}
    want = shape(trackers.cyclones_slp(msl, grid.metrics(g), d, p))
    back = lambda df: df
    if turn == "flipped":
        flip = lambda df: df.withColumn("iy", ny - 1 - F.col("iy"))
        msl, g, d, back = flip(msl), flip(g), jobs.Domain(ny, nx, 50_000.0, north=1), flip
    elif turn == "full circle":
        g = g.withColumn("lon", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")))
    else:
        g = g.withColumn("lat", F.col("lat") + 0.01 * F.col("ix")).withColumn("lon", F.col("lon") + 0.02 * F.col("iy"))
    assert shape(back(trackers.cyclones_slp(msl, grid.metrics(g), d, p))) == want and want


def _by_object(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.obj_id, []).append(r)
    return out.values()


def test_grid_report_names_what_is_wrong(spark):
    g = fields.regular_grid(spark, (10.0, 1.0, 3), (350.0, 5.0, 4))
    found = {r.subject: (r.found, r.status) for r in checks.grid_report(g, ("t", "ix", "iy"), "pm180", "descending", ("u",)).collect()}
    assert found["convention"] == ("0..360", "prepare") or found["convention"] == ("mixed", "unsupported")
    assert found["lat_order"] == ("ascending", "prepare") and found["dimensions"][1] == "prepare" and found["staggered u"][1] == "unsupported"
    bent = g.withColumn("lat", F.col("lat") + 0.1 * F.col("ix")).withColumn("lon", F.col("ix") * 2.0)
    found = {r.subject: (r.found, r.status) for r in checks.grid_report(bent, ("t", "iy", "ix"), "pm180", "descending").collect()}
    assert found["kind"][0] == "curvilinear" and found["lat_order"][1] == "ready" and found["dimensions"][1] == "ready"
    assert checks.grid_report(g.drop("lat"), ("t", "iy", "ix")).where("status = 'unsupported'").first().subject == "coordinates"


@pytest.mark.parametrize("claim", ["largest", "last"])
def test_linking_of_many_steps_at_once_is_that_of_single_steps(claim):
    rng = np.random.default_rng(4)
    steps = [(t, np.sort(rng.choice(30, rng.integers(0, 20), replace=False)).astype(np.int64)) for t in range(60)]
    t = np.concatenate([np.full(len(c), t) for t, c in steps])
    cells = np.concatenate([c for _, c in steps])
    basins = t * 100 + cells // 4
    node, first, parent = linking.parents(t, cells, basins, claim)
    want = {}
    for b in np.unique(basins):
        want[int(b)] = None
    for now in range(1, 60):
        own = {int(c): int(b) for c, b in zip(cells[t == now], basins[t == now])}
        old = {int(c): int(b) for c, b in zip(cells[t == now - 1], basins[t == now - 1])}
        chosen = {}
        for q in set(old.values()):
            shared = [own[c] for c, b in old.items() if b == q and c in own]
            if shared:
                chosen.setdefault(min(set(shared), key=lambda b: (-shared.count(b), b)), []).append(q)
        size = lambda q: list(old.values()).count(q)
        for b, qs in chosen.items():
            want[b] = min(qs, key=lambda q: (-size(q), q) if claim == "largest" else (size(q), -q))
    got = {int(basins[f]): None if p < 0 else int(basins[first[p]]) for f, p in zip(first, parent)}
    assert got == want and (basins[first][node] == basins).all()
