"""Operators that SQL expresses, against DuckDB over the given tables; and that [native] plans run no Python."""

import duckdb
import pytest

from lodestone.llm import hostrules, mixing, queries
from lodestone.llm.common import fold_of


def rows_of(cursor):
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = rows_of(con.execute(queries.oracle_sql()[name]))
    df = queries.queries()[name](spark, small)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("build", [mixing.mix, mixing.mixed, hostrules.judge_hosts])
def test_native_plans(spark, small, build):
    plan = build(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(-5, 50).select("id", fold_of("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
