"""Every query with SQL, side by side with DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weirflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(int(v))
    return "NULL" if v is None else str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = registry.ORACLE.get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    assert table_of(df.columns, got) == table_of([d[0] for d in want.description], want.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["report", "event_type", "ticks", "avg_value", "max_value"]
