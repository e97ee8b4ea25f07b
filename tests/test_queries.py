"""Every registered query that SQL expresses, against DuckDB over the same tables; the others run."""

import os

import duckdb
import pytest

from lodestone.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    found = duckdb.connect()
    for f in os.listdir(small):
        found.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    return found


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return list(value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, small, name):
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_filters_reach_the_scan(spark, small):
    plan = QUERIES["flt_nested"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "In(o_orderstatus" in plan
    assert "o_orderdate" not in plan


def test_top_k_keeps_k_rows_a_task(spark, small):
    assert "TakeOrderedAndProject" in QUERIES["vec_topk_filtered"](spark, small)._jdf.queryExecution().executedPlan().toString()
