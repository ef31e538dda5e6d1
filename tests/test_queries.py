"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    rows = sorted(tuple(plain(v) for v in row) for row in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
