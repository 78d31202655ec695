"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """haversine_distance grid_metrics normalise_grid point_on_land unit_convert front_diagnostic box_mean local_maxima label3d seam_merge relabel basin_links
    object_stats ring_fraction accumulate interpolate file_gaps stream_report rivers_ivt accumulate_streaming tracking_sink index_refresh year_files_scan canonical_sink statistics_sink link_streaming""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(df):
    """Rows in the order of their columns' names, sorted; numbers as floats."""
    cols = sorted(df.columns)
    number = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)
    rows = [tuple(map(number, r)) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else 0, str(x) if not isinstance(x, float) else "") for x in r))


def same(a, b):
    return a[0] == b[0] and len(a[1]) == len(b[1]) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * max(1, abs(x)) for r, s in zip(a[1], b[1]) for x, y in zip(r, s))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    got, want = canonical(e.queries()[name](spark, DATA).toPandas()), canonical(con.sql(e.oracle_sql()[name]).df())
    assert same(got, want)


def test_registry():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
