"""Every query that has SQL against DuckDB on the same tables; the others run."""

import glob
import math
import os

import pytest

import __spark_entry__ as driver
from bitloom.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def same(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(same(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = driver.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        cur = duck.execute(driver.oracle_sql()[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 40
