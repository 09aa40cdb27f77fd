"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from loomql import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in queries.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = [tuple(plain(r[frame.columns.index(c)]) for c in columns) for r in frame.collect()]
    cursor = oracle.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)
