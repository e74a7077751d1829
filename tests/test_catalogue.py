"""Every query of the catalogue that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from doculith.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    expected = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["type", "chunks", "average_confidence", "needs_review"]
    assert set(e.oracle_sql()) <= set(e.queries())
