"""Collocations against plain code; growth that stops early against growth of everything."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import phrases
from tests.llm.helpers import no_docs, odd_docs


def plain(rows, least=10, most=2000, share=50):
    """rows: (lang, text). The result's rows, by plain counting."""
    counts, total, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        longer, found = Counter(), []
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for inner in (p[:2], p[1:]):
                    longer[inner] = max(longer[inner], a)
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= share * a):
                cuts = [(int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 120))) if x < 60]
        marks = [rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " \x0b"]) for _ in words]
        rows.append((("en", "de", None)[i % 3], "".join(w.upper() if rng.random() < 0.1 else w for pair in zip(words, marks, strict=True) for w in pair)))
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(5).persist()


@pytest.mark.parametrize("most, start, share", [(2000, None, 50), (5, 3, 50), (40, 10, 50), (7, 1, 5), (30, 2, 100)])
def test_equals_plain_counting(made, most, start, share):
    """The small ones end after few rounds or many, with most pairs not grown."""
    rows, docs = made
    assert found(phrases.collocations(docs, least=10, most=most, share=share, start=start)) == plain(rows, 10, most, share)


def test_bounds_and_bitmaps_prune(spark, made, monkeypatch):
    """Fewer phrases of three words are counted than there are; a crowded bitmap only counts more of them."""
    rows, docs = made
    counted = []
    whole = phrases._counts

    def spy(docs, n, shared=None, least=1):
        if n == 3:
            counted.append(whole(docs, n, shared).count())
        return whole(docs, n, shared, least)

    monkeypatch.setattr(phrases, "_counts", spy)
    want = plain(rows, 10, 5)
    assert found(phrases.collocations(docs, most=5, start=8)) == want
    few = sum(counted)
    counted.clear()
    monkeypatch.setattr(phrases, "BITS", 1 << 15)
    assert found(phrases.collocations(docs, most=5, start=10**6)) == want
    assert few < sum(counted)


def test_exact_arithmetic_and_bytes(spark):
    """Scores of counts whose products pass 64 bits; order by bytes of UTF-8, not by UTF-16."""
    rows = spark.createDataFrame([(10**13, 10**13, 10**13), (3 * 10**14, 9 * 10**14, 10**15), (7, 11, 13)], "a bigint, l bigint, r bigint")
    got = [tuple(r) for r in rows.select(phrases._score("a", "l", "r"), phrases._score_bound("l")).collect()]
    assert got == [(10**6, 10**6), (10**5, 333333), (10**6 * 49 // 143, 10**6 * 7 // 11)]
    texts = [("x", "￿ q. \U00010000 q. é q.\n" * 12)]
    assert found(phrases.collocations(spark.createDataFrame(texts, "lang string, text string"))) == plain(texts)


def test_many_words_in_one_task(spark, made, monkeypatch):
    """Counts given out in the middle of a task, and pairs with numbers of their own, add up to the same."""
    rows, docs = made
    init = phrases._Sums.__init__
    monkeypatch.setattr(phrases._Sums, "__init__", lambda self, n, grown, most=50: init(self, n, grown, most))
    sums = phrases._Sums(3, None)
    import pyarrow as pa

    got = Counter()
    for lang, text in rows:
        for b in sums.add(pa.array([lang or "und"]), pa.array([text])):
            got.update({(r["lang"], r["w1"], r["w2"], r["w3"]): 0 for r in b.to_pylist()})
            for r in b.to_pylist():
                got[r["lang"], r["w1"], r["w2"], r["w3"]] += r["n"]
    for b in sums.out():
        for r in b.to_pylist():
            got[r["lang"], r["w1"], r["w2"], r["w3"]] += r["n"]
    want = {(r["lang"], r["w1"], r["w2"], r["w3"]): r["n"] for r in phrases._counts(docs.selectExpr("coalesce(lang, 'und') lang", "text"), 3).collect()}
    assert dict(got) == want and want


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found(phrases.collocations(docs, least=2)) == plain(rows, 2)
    assert found(phrases.collocations(docs)) == plain(rows)
    assert found(phrases.collocations(no_docs(spark))) == []
