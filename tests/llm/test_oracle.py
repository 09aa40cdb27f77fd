"""The queries that SQL can express against that SQL."""

import duckdb
import pytest

from loomql.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = connection.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[c] for c in names) for r in frame.collect()) == order(cursor.fetchall())
