"""Every query with SQL gives the same rows as DuckDB does at the smallest scale."""

import datetime as dt
import decimal

import duckdb
import pytest

from tallyforge import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return value.date()
    return float(value) if isinstance(value, (int, decimal.Decimal)) and not isinstance(value, bool) else value


def rows(names, found):
    return sorted(repr([plain(r[i]) for i in names]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    theirs = rows([columns.index(c) for c in sorted(columns)], cursor.fetchall())
    ours = rows([df.columns.index(c) for c in sorted(columns)], [tuple(r) for r in df.collect()])
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
