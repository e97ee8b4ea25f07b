"""Ranked search against plain code: bounds never below scores, whole rankings, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bitsliced
from tests.llm.helpers import no_docs, odd_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    """docs and items: (id, text). (item, rank, doc, score), best first."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in counts:
            if c:
                m = 25 + (75 * sum(c.values()) * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
                if s > 0:
                    found.append((-s, i is not None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_equals_plain_code_over_given_tables(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    index = bitsliced.build(docs)
    assert ranked(bitsliced.top_k(docs, index, items)) == want
    # Items in many blocks, texts that meet their keys by a shuffle, and other partitions give the same rows.
    assert ranked(bitsliced.top_k(docs, index, items, block_bytes=3000, broadcast_bytes=0)) == want
    assert ranked(bitsliced.top_k(docs, bitsliced.build(docs.repartition(5)), items)) == want


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_bounds_are_never_below_scores(bits, monkeypatch):
    """Also where signatures are so full that most bits are other terms'; and a full block, and one that isn't."""
    monkeypatch.setattr(bitsliced, "BITS_A_KEY", bits)
    monkeypatch.setattr(bitsliced, "BLOCK_BITS", 1 << 12)
    rng = np.random.default_rng(bits)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, int(n)) if x < 10**6) for n in rng.integers(0, 400, 60)] + ["t1 " * 500, "", None]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    found = [r for b in bitsliced._indexed([docs]) for r in b.to_pylist()]
    df = Counter()
    for r in found:
        if r["term"] is not None:
            df[r["term"].encode()] += r["df"]
    assert df == Counter(t.encode() for x in texts for t in set(terms(x)))
    blocks = [r for r in found if r["slices"] is not None]
    sizes = {k: n for r in blocks for k, n in zip(r["keys"], r["sizes"], strict=True)}
    assert sizes == {i: len(terms(t)) for i, t in enumerate(texts) if terms(t)}
    items = [[" ".join(f"t{int(x)}" for x in rng.zipf(1.5, 12) if x < 10**6)] for _ in range(20)] + [["nothing of it"], ["t1 t1", "t2"]]
    q = bitsliced.asked(items, df, len(sizes), sum(sizes.values()))
    h, close = bitsliced.hashes(pa.array(list(q.terms), pa.binary())), 0
    scores = {(i, s): x for i, one in enumerate(bitsliced.exact(q, pa.array(texts), [list(range(len(items)))] * len(texts))) for s, x in one}
    for r in blocks:
        bound = bitsliced.bounds(q, h, r["n_slices"], np.array(r["sizes"]), r["slices"])
        for d, key in enumerate(r["keys"]):
            for i in range(len(items)):
                score = scores.get((key, i), 0)
                assert bound[i, d] >= score
                close += bound[i, d] <= 1.2 * score
    assert len({r["n_slices"] for r in blocks}) > 1 and scores and (bits < 12 or close > 0.5 * len(sizes) * len(items))


def test_ties_repeats_and_counts(spark):
    """Copies take ranks by id, whatever their number; repeated terms of items and documents count; all levels of counts."""
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(100 + n, "many " * n + "other words") for n in (1, 2, 3, 4, 5, 8, 9, 13, 14, 23, 24, 47, 48, 90)] + [(7, "same words here")] * 2
    items = [("a", "Same, SAME words"), ("b", "many"), ("c", "absent"), ("d", None), ("e", "words"), (None, "other"), ("b", "here many")]
    docs, asked = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    got = ranked(bitsliced.top_k(docs, bitsliced.build(docs), asked))
    assert got == plain_ranking(rows, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == "a"] == [1, 2, 3, 4, 5, 6, 7, 7, 7, 8]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "quick fox 日本語 İstanbul"), (2, None), (3, ""), (4, "short, another TEXT"), (5, "x" * 30_000), (5, "fox"), (None, "dog")]
    asked = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id bigint, text string, rank string")
    index = bitsliced.build(docs)
    assert ranked(bitsliced.top_k(docs, index, asked)) == plain_ranking(rows, items)
    assert ranked(bitsliced.top_k(docs, index, asked.where("false"))) == []
    none = no_docs(spark)
    assert ranked(bitsliced.top_k(none, bitsliced.build(none), asked)) == []
    assert ranked(bitsliced.top_k(docs, index, asked.where("item_id = 2"))) == []
