"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from storytide.queries.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import storytide.queries  # noqa: E402, F401  registers

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime) and (v.hour, v.minute, v.second) == (0, 0, 0):
        v = v.date()
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


#: Heavy window series share their code; one of each kind is enough here, the gate runs all.
LIGHT = sorted(set(SQL) - {"pooled_density", "coverage_states", "rolling_distinct_7d", "strided_baseline_mad", "trailing_peak_90d", "lag_change_acceleration", "change_state_counts", "bool_and_complete_dates", "peak_positions", "no_information_suppression", "backtest_first_fire"})


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(cols, r, strict=True))) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()), key=str)
    assert got == want
