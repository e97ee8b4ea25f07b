import random
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import neardup


def _grams(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _alike(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 1.0


def brute(texts):
    grams, parent = {i: _grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and _alike(grams[a], grams[b]) >= 0.8:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for i in texts:
        classes[find(i)].append(i)
    return {i: min(c) for c in classes.values() for i in c}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 220))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    phrase = " ".join(rng.choice(words) for _ in range(8))
    out += [" ".join([phrase] * k) for k in (2, 5, 6, 40, 41)]
    return dict(enumerate(out))


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_chains_of_likeness_in_one_bucket(spark):
    """Neighbours are alike, ends are not: centres alone would miss links."""
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for k in range(12):
        own = list(base)
        for j in range(4 * k):
            own[j * 6] = f"x{j}"
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    for shared in (60, 150, 270):
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 300 - shared).astype(np.uint64)])
        s = neardup.signatures([np.sort(a), np.sort(b)], 1024)
        assert abs((s[0] == s[1]).mean() - shared / (600 - shared)) < 0.06


def test_signature_of_a_set_does_not_depend_on_its_company():
    sets = [neardup.cells([f"{i}-{j}".encode() for j in range(n)]) for i, n in enumerate((0, 1, 7, 5000))]
    alone = np.concatenate([neardup.signatures([s], 96) for s in sets])
    assert (alone == neardup.signatures(sets, 96)).all() and not alone[0].any() and alone[1:].all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (202, 201)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
