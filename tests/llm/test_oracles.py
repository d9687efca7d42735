"""Queries that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from revspark.llm.oracle import ORACLE
from revspark.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r) for r in want.select(*columns).fetchall()), key=repr)
