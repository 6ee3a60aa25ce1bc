"""Every registered query with an oracle gives DuckDB's rows on the small tables."""

import decimal
import math

import duckdb
import pytest

from sieverank.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(ours.columns)) for r in ours.collect()), key=str)
    theirs = duck.execute(ORACLES[name])
    names = [x[0] for x in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in theirs.fetchall()), key=str)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
