"""Every query with SQL gives the same rows as DuckDB at the smallest size."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from matchgrid.plans import catalog
from matchgrid.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    result = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    got = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=str)
    assert got == want


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["a01_player_seasons", "w01_keep_preferred"])
def test_raw_rows_are_shuffled_once_and_narrow(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "l_suppkey" in shuffles[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["l06_slippage_to_mid", "l07_market_metrics_series"])
def test_books_are_made_once_for_windows_over_them(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # the spans of the book; each pass of the window would make them again
