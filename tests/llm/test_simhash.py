"""SimHash groups against plain code over all pairs, and the ring against all rotations."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestone.llm import queries, simhash
from tests.llm.helpers import no_docs, odd_docs


def plain_fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=3):
    """By fingerprint: a number that linked ones share."""
    left, of, n = list(dict.fromkeys(prints)), {}, 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            one = todo.pop()
            of[one] = n
            near = [p for p in left if (p ^ one).bit_count() <= most]
            left = [p for p in left if (p ^ one).bit_count() > most]
            todo += near
    return of


def plain_groups(rows, most=3):
    """(doc_id, fingerprint, least id of its component), sorted."""
    prints = [plain_fingerprint(t) for _, t in rows]
    of, least = plain_components(prints, most), {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted([(i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints, strict=True)], key=repr)


def found(df):
    return sorted([(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect()], key=repr)


def test_query_equals_all_pairs(spark, small):
    df = queries.op12_simhash_groups(spark, small)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain_groups(rows)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()], key=repr) == want
    assert len({w[2] for w in want}) < len(want)  # something links


def test_fingerprints_of_many_words():
    """Beyond 255 runs, where sums of bytes would overflow; one and two words; texts beyond a part."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 9, n)) for n in (0, 1, 2, 3, 254, 257, 258, 900, 3000)] + [None, "É A\tB\x0bc\n", " \n "]
    got = simhash.fingerprints(pa.array(texts)).tolist()
    assert got == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(pa.array(["x", *texts, "y"]).slice(1, len(texts))).tolist() == got


def test_majority_needs_over_half():
    h = np.array([0b11, 0b01, 0b10, 0b00], np.uint64)
    assert simhash.majority(h, np.array([2, 0, 2])).tolist() == [0b01, 0, 0]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_masks_and_chains_lose_no_link(most):
    rng, masks = np.random.default_rng(most), np.array(simhash.chain_masks(most), np.uint64)
    for _ in range(3000):
        x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most + 1), replace=False)) if most else 0
        assert (masks & np.uint64(x) == 0).any()
        assert simhash.linked(np.array([x], np.uint64), most)[0]
        finer = simhash.finer_masks(int(masks[0]), most)
        if not x & int(masks[0]):
            assert any(not x & m for m in finer)


def test_buckets_of_any_size(spark):
    """Crowded buckets that are dealt anew: fingerprints that differ in their low bits only, beside chains of links."""
    rng = np.random.default_rng(5)
    near = {int(x) for x in rng.integers(0, 1 << 20, 9000)} | {int(x) << 44 for x in rng.integers(0, 1 << 18, 300)}
    far = [((1 << 4 * i) - 1) << 2 for i in range(1, 14)] + [int(x) for x in rng.integers(0, 1 << 62, 2000)]
    prints = sorted(near | set(far))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    rows = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.fingerprint_links(df, 3).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in rows)
    of = {p: p for p in prints}

    def root(p):
        while of[p] != p:
            of[p] = of[of[p]]
            p = of[p]
        return p

    for a, b in rows:
        of[root(a)] = root(b)
    x = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3):
            assert root(p) == root(prints[i + 1 + int(j)])


def test_links_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(simhash.simhash_groups(docs.repartition(7))) == found(simhash.simhash_groups(docs))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = simhash.simhash_groups(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["fp", "component_id"]
    assert found(out) == plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(simhash.simhash_groups(no_docs(spark))) == []
    alone = spark.createDataFrame([(None, "one text here")], "doc_id bigint, text string")
    assert found(simhash.simhash_groups(alone))[0][2] is None
