"""Every query with SQL against DuckDB, and every other one for rows, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from lineweave import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    assert canonical(df.columns, rows) == canonical([c[0] for c in found.description], found.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
