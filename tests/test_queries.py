"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return f"{float(value):.9g}" if type(value).__name__ in ("float", "Decimal") else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    result = duck.sql(SQL[name])
    places = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())
