"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from sieverank.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    theirs = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in theirs.description]
    ours = QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(theirs.fetchall())
