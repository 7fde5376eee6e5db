"""Every registered query with SQL, beside DuckDB, over the whole smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from logmill.queries import QUERIES, SQL


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "[" + ",".join(map(cell, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(name, spark, small, con):
    df = QUERIES[name](spark, small)
    r = con.sql(SQL[name])
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(r.fetchall(), r.columns)


def test_entry_lists_every_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
