"""Registered queries against their SQL, and the entry without this subpackage's pipeline."""

import os

import duckdb
import pytest

from lodestrand.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_names():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)] and set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in df.collect()))) == sorted(map(str, rel.fetchall()))
