"""Every registered query against its SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import pytest

import __spark_entry__ as entry
from forgemart.oracle.queries import ORACLE
from forgemart.registry import QUERIES

duckdb = pytest.importorskip("duckdb")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
TYPES = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    result = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    expected = table(list(types), result.fetchall())
    assert table(df.columns, df.collect()) == expected
    assert expected


def test_entry(spark):
    assert entry.entry(spark).count() == 8
