"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from foliant import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SMALL):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return connection


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    expected = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert all(len(r) for r in catalog.QUERIES[name](spark, SMALL).collect())  # values: test_values.py


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
