"""Every query with SQL agrees with it on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert plain(got.select(*order).collect()) == plain(want.select(*order).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
