"""Every query against its oracle in DuckDB; those without one must give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from cutgraph.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"fuzzy_match", "retakes"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str | datetime.datetime):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return round(float(value), 9)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in ORACLES:
        told = duck.execute(ORACLES[name])
        columns = [d[0] for d in told.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, told.fetchall())
