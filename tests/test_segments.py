"""The index in segments: the same ranking as an index built afresh, whatever was taken in, removed and merged."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import store
from lodestone.operators import bm25
from lodestone.operators.filters import Range, Term
from lodestone.operators.segments import SegmentIndex
from lodestone.plans.retrievers import KeywordRetriever
from lodestone.snapshots import Conflict
from lodestone.types import metadata


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}ing" for a in "bcdfghjklm" for b in ("a", "oo", "ea", "ur", "ist")]
    return [" ".join(words[x] for x in np.minimum(rng.zipf(1.3, int(rng.integers(1, 60))), len(words)) - 1) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, text string").repartition(3)


def best(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


def built(spark, rows):
    return bm25.build(frame(spark, rows), stopwords=bm25.ENGLISH, stemming=True)


def fresh(whole, query, k):
    return best(bm25.score(whole, query).orderBy(F.desc("score"), "id").limit(k))


@pytest.fixture
def index(spark, tmp_path):
    return SegmentIndex(spark, f"file://{tmp_path}/index", id_type=T.IntegerType())


def same(spark, index, rows, queries=("baing booing", "the misting of curing and absents"), k=7):
    whole = built(spark, rows)
    for q in queries:
        assert best(index.top_k(q, k)) == fresh(whole, q, k), q


def test_ingest_remove_merge(spark, index):
    rows = list(enumerate(texts(120)))
    assert index.ingest(frame(spark, rows[:50])) == 50 and index.ingest(frame(spark, rows[50:])) == 70
    same(spark, index, rows)
    gone = spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(5,), (5,), (999,)], "id int")
    assert index.remove(gone) == 41 and index.remove(gone) == 0
    rows = [r for r in rows if r[0] % 3 and r[0] != 5]
    assert index.state().documents == len(rows)
    same(spark, index, rows)
    # A removed id may come back, and a later removal takes only what is there.
    back = [(3, "baing curing"), (6, None), (500, "the of")]
    index.ingest(frame(spark, back))
    same(spark, index, rows + back)
    assert index.merge(60) == 2 and len(index.state().segments) == 2
    same(spark, index, rows + back)
    assert index.remove(spark.createDataFrame([(3,), (4,)], "id int")) == 2
    rows = [r for r in rows + back if r[0] not in (3, 4)]
    same(spark, index, rows)
    assert index.merge() == 2 and index.state().removals == [] and len(index.state().segments) == 1 and index.merge() == 0
    same(spark, index, rows)
    again = SegmentIndex(spark, index.path, id_type=T.IntegerType())
    assert best(again.top_k("baing", 5)) == best(index.top_k("baing", 5))
    with pytest.raises(ValueError):
        SegmentIndex(spark, index.path, id_type=T.IntegerType(), stemming=False)


def test_empty(spark, index):
    assert best(index.top_k("word")) == [] and index.remove(frame(spark, [(1, "x")])) == 0 and index.merge() == 0
    assert index.ingest(frame(spark, [])) == 0 and index.ingest(frame(spark, [(1, None), (2, "")])) == 2
    assert best(index.top_k("word")) == [] and index.state().documents == 2


def test_blocks_that_cannot_matter_are_not_read(spark, index):
    """A common word in long texts, and a few short texts that are all about it: most blocks lie below the floor."""
    rng = np.random.default_rng(2)
    rows = [(i, "common " + " ".join(f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(40, 200))))) for i in range(2600)]
    rows += [(3000 + i, "common " * 6 + "rare" * (i % 2)) for i in range(20)]
    index.ingest(frame(spark, rows[:2000]))
    index.ingest(frame(spark, rows[2000:]))
    state, whole = index.state(), built(spark, rows)
    for query, k in (("common", 10), ("common rare", 5), ("rare commons", 10)):
        every = index._postings(state.segments).where(F.col("term").isin(bm25.query_tokens(query, index.stopwords, index.ignore, True)))
        read, _, _ = index.blocks_for(query, k)
        n, m = read.count(), every.count()
        assert m > 20 and 0 < n < m / 3, (query, n, m)
        assert best(index.top_k(query, k)) == fresh(whole, query, k)
    plan = index.blocks_for("common", 10)[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(peak" in plan and "EqualTo(term,common)" in plan
    # Ties beyond k, and more asked for than there are.
    assert best(index.top_k("rare", 3)) == fresh(whole, "rare", 3) and len(best(index.top_k("rare", 50))) == 10


def test_races(spark, index):
    """A merge during which documents are removed changes nothing; a removal that meets a merge looks again."""
    rows = list(enumerate(texts(40, 4)))
    index.ingest(frame(spark, rows[:20]))
    index.ingest(frame(spark, rows[20:]))
    write = index._write

    def slow(df, replaced, base):
        SegmentIndex(spark, index.path, id_type=T.IntegerType()).remove(frame(spark, [(7, "")]))
        return write(df, replaced, base)

    index._write = slow
    with pytest.raises(Conflict):
        index.merge()
    index._write = write
    same(spark, index, [r for r in rows if r[0] != 7])
    found = []
    threads = [threading.Thread(target=lambda i=i: found.append(SegmentIndex(spark, index.path, id_type=T.IntegerType()).remove(frame(spark, [(i, ""), (8, "")])))) for i in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(found) == 4
    same(spark, index, [r for r in rows if r[0] not in (1, 2, 3, 7, 8)])


def test_retriever_follows_its_table(spark, tmp_path):
    documents = store.DocumentTable(spark, "keyword_docs", metadata(n="int32"), replace=True)
    both = KeywordRetriever(documents, SegmentIndex(spark, f"file://{tmp_path}/index"))
    rows = [("a", "Running in the woods", 1), ("b", "the runners run and run", 2), ("c", "cooking at home", 3)]
    assert both.ingest(spark.createDataFrame(rows, "id string, text string, n int")).affected_rows == 3
    assert [r["id"] for r in both.retrieve("runs").collect()] == ["b", "a"]  # by stems
    assert both.retrieve("the").isEmpty() and [r["id"] for r in both.retrieve("run", 5, Range("n", 0, 2)).collect()] == ["a"]
    assert both.remove(Term("n", 2)) == 1 and [r["id"] for r in both.retrieve("running").collect()] == ["a"] and documents.count() == 2
    documents.drop()
