"""Every query against its SQL, on the smallest sample tables."""

import os

import duckdb
import pytest

from lodestrand.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = _rows(df.columns, df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert got == _rows(rel.columns, rel.fetchall())


def test_plans_have_no_nested_loops_on_range_keys(spark):
    for name in ("temporal_co_occurrence", "repeated_overlap", "spatial_pairs_haversine", "co_location_pairs"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = QUERIES["scan_project_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
