"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest

from eventlake import plans
from eventlake.session import ship_package

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    ship_package(spark)
    got = plans.queries()[name](spark, SF)
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    ship_package(spark)
    assert plans.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert plans.flagship(spark, SF).count() == 20
