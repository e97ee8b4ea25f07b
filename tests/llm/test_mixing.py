import math
from collections import defaultdict

import pytest

from lodestone.llm import mixing


def brute_targets(sizes, weights, share, most):
    """Deals out by weight and reshares what is over, until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 3000, "d": 10, None: 7}, {"x": 5}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in got)


def test_mix_meets_its_targets_and_reruns_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r["doc_id"]: r["copies"] for r in rows} == again
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
    by_source = defaultdict(set)
    for r in rows:
        by_source[r["source"]].add(r["copies"])
    assert all(max(c) - min(c) <= 1 for c in by_source.values())  # whole epochs first


def test_better_documents_come_first(spark):
    rows = [(i, ("good words " * 10) if i % 2 else ("b@d #### $$$$ " * 10), "s") for i in range(4000)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), share=0.3).collect()
    good = sum(r["copies"] for r in plan if r["doc_id"] % 2)
    assert good > 1.4 * sum(r["copies"] for r in plan if r["doc_id"] % 2 == 0)


def test_mixed_repeats_rows(spark):
    rows = [(i, "w " * 5, s) for i, s in enumerate("aaab")] + [(0, "w " * 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    assert mixing.mixed(docs).count() == want
