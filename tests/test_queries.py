"""Every query of the library that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from buildlens import queries


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(round(x, 6) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else x if x is None else str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(queries.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
