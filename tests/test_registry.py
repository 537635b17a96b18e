"""Every registered query against its SQL on the smallest tables, over all their rows."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, tables, name):
    df = contract.queries()[name](spark, FOLDER)
    got = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = tables.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
