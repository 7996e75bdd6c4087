"""Queries with SQL against DuckDB, over sf0.001."""

import os

import duckdb
import pytest

from glossa.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    assert sorted(ours[cols].astype(str).itertuples(index=False)) == sorted(theirs[cols].astype(str).itertuples(index=False))
