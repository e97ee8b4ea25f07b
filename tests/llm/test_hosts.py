"""Verdicts on hosts that decide, against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import hostrules


def corpus():
    """Thirty usual hosts, a large bad one, one that is bad by two documents only, and one without a name."""
    rng = random.Random(11)
    good = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(10**6)) for _ in range(20))
    rows = []
    for host, n, failing in [*((f"h{i}", 60, 2 + i % 4) for i in range(30)), ("bad", 300, 120), ("tiny", 2, 2), (None, 40, 1), ("", 40, 2)]:
        rows += [(len(rows) + i, "too short" if i < failing else good(), host) for i in range(n)]
    return rows


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_hosts_decide(spark, most_bytes):
    rows = corpus()
    found = hostrules.judge_hosts(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), most_bytes=most_bytes).collect()
    assert len(found) == len(rows)
    by = {}
    for _, t, h in rows:
        by.setdefault(h, []).append(len(t.split()) < 10)
    shares = [sum(x) / len(x) for x in by.values()]
    mean = sum(shares) / len(shares)
    variance = max(sum(s * s for s in shares) / len(shares) - mean * mean - mean * (1 - mean) * sum(1 / len(x) for x in by.values()) / len(shares), 0)
    k = min(max(mean * (1 - mean) / variance - 1, 1.0), 1000.0)
    a, b = round(mean * k, 6), round((1 - mean) * k, 6)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        own = by[r["host"]]
        n = len(own) + a + b
        rate = (sum(own) + a) / n
        kept = rate - 2 * math.sqrt(rate * (1 - rate) / (n + 1)) <= min(0.5, 3 * a / (a + b))
        failed = len(texts[r["doc_id"]].split()) < 10
        assert r["host_rate"] == pytest.approx(rate) and r["base_failed"] == failed and r["kept"] == (kept and not failed)
    lost = {r["host"] for r in found if not r["kept"] and not r["base_failed"]}
    assert lost == {"bad"}


def test_hosts_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string, kept string, host string")
    assert hostrules.judge_hosts(none).collect() == []
    one = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id bigint, text string, source string")
    assert [(r["base_failed"], r["kept"], r["host"]) for r in hostrules.judge_hosts(one).collect()] == [(True, False, None)] * 2


def test_weights_of_the_mix(spark):
    """A given weight decides which documents come first; those without one come last."""
    from lodestone.llm import mixing

    rows = [(i, "word " * 10, "a", 50.0 if i % 4 == 0 else None if i % 4 == 1 else 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    taken = [r["doc_id"] for r in mixing.mix(docs, weights=(1.0,), share=0.25, weight="score").where(F.col("copies") > 0).collect()]
    assert len(taken) == 100 and sum(i % 4 == 0 for i in taken) > 80 and not any(i % 4 == 1 for i in taken)
