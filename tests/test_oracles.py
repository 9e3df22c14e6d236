"""Every query that SQL can express gives DuckDB's rows on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import quillon.queries  # noqa: F401
from quillon.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def _plain(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def compare(spark, duck, run, sql):
    got = run(spark, DATA)
    expected = duck.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    kinds = {n: TYPES.get(str(t), str(t)) for n, t in zip(expected.columns, expected.types, strict=True)}
    assert {n: t for n, t in got.dtypes} == kinds
    place = [expected.columns.index(n) for n in names]
    theirs = sorted(tuple(_plain(r[i]) for i in place) for r in expected.fetchall())
    ours = sorted(tuple(_plain(r[n]) for n in names) for r in got.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["term", "count", "other"]
    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
