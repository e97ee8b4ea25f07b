"""Queries over tables that the given ones don't hold the like of, against their SQL, and operators over larger batches."""

from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import bm25, chunking, tokenizing
from lodestone.plans.queries import QUERIES, SQL
from lodestone.streaming import jobs
from tests.test_queries import plain


def compared(spark, name: str, folder, **tables: str) -> tuple[list, list]:
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, made in tables.items():
        con.execute(f"copy ({made}) to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    return sorted((tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, str(folder)).collect()), key=repr), want


def test_changes_of_customers_without_orders(spark, small, tmp_path):
    some = f"from '{small}/orders.parquet' where o_custkey % 7 <> 3"
    orders = f"select o_orderkey, o_custkey, o_orderstatus {some} union all select o_orderkey + 1000000, o_custkey + 1000000, o_orderstatus {some} union all select 5, null, 'O'"
    got, want = compared(spark, "change_sets", tmp_path, customer=f"from '{small}/customer.parquet'", orders=orders)
    assert got == want and any(r[1] is None and r[2] is not None for r in got)


def test_alike_up_to_rounding_and_many_copies(spark, small, tmp_path):
    docs = "select 100000 - i as doc_id, repeat(substr('then which other ', 1 + i % 3, 5 + i % 7), 1 + i % 50) as text, 'en' as lang from range(3000) t(i) union all select 200000, null, 'en'"
    got, want = compared(spark, "rag_prompt", tmp_path, documents=docs, conversations=f"from '{small}/conversations.parquet' where conv_id < 5")
    assert len(got) > 5 and got == want


def test_words_are_counted_where_texts_are_read(spark):
    texts = ["Élan élan, a\\nb x_y", "İstanbul KKelvin ẞ ﬁ", "", None, "the other the thé", "\\\\a \\\r b", "running runs \U0001f600ran"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for stopwords, ignore, stemming in ((frozenset(), bm25.IGNORE, False), (bm25.ENGLISH, bm25.IGNORE, True), (frozenset({"a"}), "[^a-z0-9é]+", False)):
        own = bm25.tokens(F.coalesce("text", F.lit("")), stopwords, ignore, stemming)
        rows = docs.select("id", own.alias("w"), bm25.counted(F.col("text"), stopwords, ignore, stemming).alias("c"))
        for r in rows.collect():
            assert r["c"]["length"] == len(r["w"]) and dict(zip(r["c"]["terms"], r["c"]["tfs"], strict=True)) == Counter(r["w"]), r
    plan = docs.select(bm25.counted(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_texts_go_through_python_in_stretches():
    texts = pa.array(["and the line\nanother", None, "", "x" * 3_000_000, *["the end\n" * 1000] * 500])
    splitter = chunking.CharacterSplitter(size=800, overlap=100, separator="\n")
    for f in (chunking.chunks_of(splitter), chunking.chunks_of(chunking.RecursiveSplitter(400, 40)), tokenizing.encoder(tokenizing.BytePairs(((116, 104),)))):
        parts = list(f.func(iter([texts, texts[:0], texts[:2]])))
        assert sum(map(len, parts)) == len(texts) + 2 and max(map(len, parts)) < 200
    each = [r for part in chunking.chunks_of(splitter).func(iter([texts])) for r in part.to_pylist()]
    assert [[c["text"] for c in r] for r in each] == [splitter.split(t or "") for t in texts.to_pylist()]


def test_streams_of_several_files(spark, small, tmp_path, monkeypatch):
    spark.read.parquet(f"{small}/documents.parquet").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    seen, ingest = [], jobs.ingest

    def spy(spark, source, *args, **options):
        seen.append((len(spark.read.parquet(source).inputFiles()), options["files_a_batch"]))
        return ingest(spark, source, *args, **options)

    monkeypatch.setattr(jobs, "ingest", spy)
    got = {tuple(r) for r in QUERIES["stream_distinct"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as from '{small}/documents.parquet'")
    assert got == set(con.execute(SQL["stream_distinct"]).fetchall()) and seen[0][0] > 2 and seen[0][1] <= seen[0][0] // 2
