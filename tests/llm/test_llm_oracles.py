"""Corpus queries against their DuckDB statements on the smallest tables."""

import duckdb
import pytest

from regimera.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in q.fetchall())


def test_names():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
