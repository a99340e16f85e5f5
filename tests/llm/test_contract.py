"""What SQL can express of operators 5, 7 and 9, against DuckDB, and its check sum against zlib's."""

import glob
import os
import zlib

import duckdb
import pytest

from buildlens.llm import contract


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = contract.queries()[name](spark, small), c.sql(contract.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[x] for x in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_check_sum():
    rows = duckdb.sql(f"select doc_id, {contract._CRC32} from (select unnest([0, 7, -3, 123456, 9007199254740993]) as doc_id)").fetchall()
    assert all(v == zlib.crc32(str(k).encode()) for k, v in rows)
