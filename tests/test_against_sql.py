"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from govflow.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (bool, str)) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:19].removesuffix(" 00:00:00")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, got) == rows_of(found.columns, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["year", "budget", "contract", "paid"]
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(entry.SMOKE_DIR)
