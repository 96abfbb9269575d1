"""Queries that SQL can express, against that SQL on whole small tables."""

import duckdb
import pytest

from graphsieve.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want, key=repr)
