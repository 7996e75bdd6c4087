"""Every query with SQL gives what DuckDB gives, over sf0.001; every other query runs."""

import math
import os

import duckdb
import pytest

from glossa.plans import oracle
from glossa.plans import queries as plans

SQL = oracle.sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def text(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf, name):
    ours, theirs = plans.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() >= 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(plans.queries())
