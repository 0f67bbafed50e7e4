"""Every registered query against its DuckDB statement, on the smallest tables."""

import math

import duckdb
import pytest

from regimera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = duck.sql(catalog.ORACLES[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
