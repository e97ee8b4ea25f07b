import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import passages


def brute_best(matches, k, gap):
    """Score of the best chain, by trying every predecessor."""
    matches = sorted(set(matches))
    best = []
    for i, (p, q) in enumerate(matches):
        before = [best[j] - gap * (p - matches[j][0] + q - matches[j][1]) for j in range(i) if matches[j][0] < p and matches[j][1] < q]
        best.append(k + max([0, *before]))
    return max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=30))
def test_best_chain_equals_brute_force(matches):
    found = passages.chains(matches, k=8, gap=0.1, least=1)
    score = lambda c: 8 * len(c) - 0.1 * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
    assert max(map(score, found)) == pytest.approx(brute_best(matches, 8, 0.1))
    assert sorted(m for c in found for m in c) == sorted(set(matches))
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:], strict=False))


def test_seeds_are_guaranteed():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**60, 200).astype(np.uint64) for _ in range(2))
    shared = rng.integers(0, 2**60, 23).astype(np.uint64)  # window + k - 1 words
    left, right = (set(passages.seeds(np.concatenate([x[:90], shared, x[90:]]))[0].tolist()) for x in (a, b))
    assert left & right


def test_planted_passages_are_found_and_others_left(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs, where = text(60), [], {}
    for i in range(40):
        own = text(rng.randint(60, 300))
        if i % 4 == 0:
            copy = list(passage)
            for _ in range(i % 3):
                copy[rng.randrange(5, 55)] = "edited"
            at = rng.randint(0, len(own))
            own, where[i] = own[:at] + copy + own[at:], at
        docs.append((i, " ".join(own)))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {x for r in rows for x in (r["doc_id"], r["other_id"])} == set(where)
    for r in rows:
        assert abs(r["start"] - where[r["doc_id"]]) <= 6 and abs(r["stop"] - where[r["doc_id"]] - 60) <= 6
        assert r["agree"] >= 0.8 * (r["stop"] - r["start"])


def test_repeats_inside_one_document(spark):
    rng = random.Random(6)
    part = [f"w{rng.randrange(5000)}" for _ in range(70)]
    text = " ".join(part + [f"x{i}" for i in range(30)] + part)
    rows = passages.repeated_passages(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["stop"], r["other_start"]) for r in rows] == [(1, 1, 100, 170, 0)]


def test_exact_copies(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = passages.repeated_passages(spark.createDataFrame([(i, text) for i in range(6)], "doc_id bigint, text string")).collect()
    assert len(rows) == 5 and all((r["start"], r["stop"], r["agree"]) == (0, 200, 200) for r in rows)
    assert len({r["other_id"] for r in rows}) == 1


@pytest.mark.parametrize("gap", [20, 100, 400])
def test_passages_with_unrelated_words_between(spark, gap):
    rng = random.Random(gap)
    new = iter(f"w{i}" for i in range(10_000))
    text = lambda n: [next(new) for _ in range(n)]
    sizes = [60, 60, 300, 45, rng.randint(60, 90)]
    parts = [text(n) for n in sizes]
    docs, where = [], []
    for i in range(2):
        own, at = text(30), []
        for part in parts:
            at.append((len(own), len(own) + len(part)))
            own += part + text(gap)
        docs.append((i, " ".join(own)))
        where.append(at)
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for r in rows:
        assert min(r["stop"] - r["start"], r["other_stop"] - r["other_start"]) >= 40
        assert r["agree"] >= 0.8 * max(r["stop"] - r["start"], r["other_stop"] - r["other_start"])
    covered = {x for r in rows for x in range(r["start"], r["stop"])}
    assert all(covered.issuperset(range(*w)) for w in where[rows[0]["doc_id"]])
    if gap > 75:  # no two parts make one passage across the gap
        assert sorted((r["start"], r["stop"]) for r in rows) == where[rows[0]["doc_id"]]


def test_passages_of_the_stated_likeness_are_found(spark):
    """Changed words at even distances and at random, from 0.8 alike up: against the passages planted."""
    rng, docs, want = random.Random(8), [], {}
    for i in range(120):
        size, kind = rng.choice((45, 60, 90)), i % 6
        text = lambda n, i=i: [f"w{i}x{rng.randrange(10**9)}" for _ in range(n)]
        passage = text(size)
        copy = list(passage)
        at = range(4, size - 1, kind + 5) if kind < 4 else rng.sample(range(1, size - 1), int(size * (0.12, 0.18)[kind - 4]))
        for j in at:
            copy[j] = f"edit{rng.randrange(10**9)}"
        a, b = text(rng.randint(30, 200)), text(rng.randint(30, 200))
        docs += [(2 * i, " ".join(a + passage + text(50))), (2 * i + 1, " ".join(b + copy + text(50)))]
        want[2 * i] = size, kind, {2 * i: len(a), 2 * i + 1: len(b)}
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        assert {r["doc_id"], r["other_id"]} == {r["doc_id"] // 2 * 2, r["doc_id"] // 2 * 2 + 1}
        got[r["doc_id"] // 2 * 2] = r
    beyond = lambda i, size, at: (got[i]["start"] - at[got[i]["doc_id"]], got[i]["stop"] - at[got[i]["doc_id"]] - size)
    near = {i for i, (size, _, at) in want.items() if i in got and beyond(i, size, at)[0] >= -8 and beyond(i, size, at)[1] <= 8 and got[i]["stop"] - got[i]["start"] >= 0.8 * size}
    missed = [(size, kind) for i, (size, kind, _) in want.items() if i not in near]
    assert not [m for m in missed if m[1]] and len(missed) <= 2, missed  # evenly at 0.8 a seed may be lost


def covered_by(rows):
    """Words of each document that its rows, on either side, cover."""
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
        out.setdefault(r["other_id"], set()).update(range(r["other_start"], r["other_stop"]))
    return out


@pytest.mark.parametrize("step", [10, 12, 14, 16, 20])
def test_several_edited_passages_a_document(spark, step):
    """Documents in groups that share some of a few passages, each copy edited at every ``step``-th word, against the places planted."""
    rng, new = random.Random(step), iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    docs, planted = [], {}
    for group in range(25):
        parts = [text(rng.randint(50, 120)) for _ in range(3)]
        for member in range(3):
            own, i = text(rng.randint(5, 80)), 3 * group + member
            for k, part in enumerate(parts):
                if k == member:  # each two of the three share another part
                    continue
                shift = rng.randrange(step)
                copy = [f"edit{next(new)}" if (j + shift) % step == 0 else w for j, w in enumerate(part)] if member else part
                planted.setdefault(i, set()).update(range(len(own), len(own) + len(copy)))
                own += copy + text(rng.randint(20, 300))
            docs.append((i, " ".join(own)))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert all(r["doc_id"] // 3 == r["other_id"] // 3 for r in rows)
    got = covered_by(rows)
    # Two copies with edits of their own, at every tenth word each, are 0.8 alike: at the edge of what counts.
    found = sum(len(got.get(i, set()) & at) for i, at in planted.items()) / sum(map(len, planted.values()))
    beyond = sum(len(at - planted[i]) for i, at in got.items()) / sum(map(len, got.values()))
    assert found >= (0.98 if step > 10 else 0.95) and beyond <= 0.02, (found, beyond)


def test_a_leader_that_has_only_part_of_a_passage(spark):
    """Families in which the others share a passage, of which one document has a part that is too short; every other one is found."""
    new = iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    docs, whole = [], set()
    for group in range(30):
        part = text(60)
        for member in range(4):
            shared = part[:30] if member == 0 else part
            docs.append((4 * group + member, " ".join(text(100) + shared + text(100))))
            whole |= {4 * group + member} if member else set()
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got = covered_by(rows)
    assert set(got) == whole and all(len(at) >= 58 for at in got.values())


@pytest.mark.parametrize("half", [25, 35])
def test_leaders_that_have_a_part_each(spark, half):
    """B and C share a passage whole, A1 its first half and A2 its second: in every order of the leaders B and C have it, and the As don't."""
    new = iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    docs, want = [], {}
    for group in range(60):
        part = text(2 * half)
        for member, shared in enumerate((part[:half], part[half:], part, part)):
            own = text(100)
            docs.append((4 * group + member, " ".join(own + shared + text(100))))
            if member > 1:
                want[4 * group + member] = set(range(len(own), len(own) + 2 * half))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    got = covered_by(rows)
    assert set(got) == set(want) and all(len(got[i] & at) >= 2 * half - 1 and len(got[i] - at) <= 2 for i, at in want.items())
    assert all(r["doc_id"] // 4 == r["other_id"] // 4 and r["agree"] >= 0 for r in rows)


def test_many_leaders_of_parts(spark):
    """A passage of 120 words, whole in three documents, and in six others by thirds, before, between and behind one another."""
    new = iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    docs, want = [], {}
    for group in range(20):
        part = text(108)
        for member in range(9):
            shared = part if member < 3 else part[36 * (member % 3) : 36 * (member % 3 + 1)]
            own = text(60)
            docs.append((9 * group + member, " ".join(own + shared + text(60))))
            if member < 3:
                want[9 * group + member] = set(range(60, 168))
    got = covered_by(passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    assert set(got) == set(want) and all(len(got[i] & at) >= 106 for i, at in want.items())


def test_crowded_seeds(spark):
    """A passage in every document: one row for each but the leaders, all of it found."""
    rng, new = random.Random(4), iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    part = text(55)
    docs = [(i, " ".join(text(rng.randint(0, 60)) + part + text(rng.randint(0, 60)))) for i in range(400)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got = covered_by(rows)
    assert len(got) == 400 and all(55 <= len(at) <= 56 for at in got.values())
    assert 399 <= len(rows) <= 400 + 50


def test_given_documents_against_every_pair(spark, small):
    """All pairs of the smallest table, all shared runs of four words, chained and aligned without seeds or leaders."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    h = {i: (passages.word_hashes(t) >> np.uint64(32)).astype(np.uint32) for i, t in texts.items()}
    at = {}
    for i, x in h.items():
        for p in range(len(x) - 3):
            at.setdefault(tuple(x[p : p + 4].tolist()), []).append((i, p))
    matches = {}
    for places in at.values():
        for n, (i, p) in enumerate(places):
            for j, q in places[:n]:
                if i != j:
                    matches.setdefault((i, j), []).append((p, q))
    want = {}
    for (i, j), pairs in matches.items():
        if len(pairs) > 1:
            for chain in passages.chains(pairs, 4, passages.GAP, 2):
                for s, e, t, u, _ in passages.align(h[i], h[j], chain, 4):
                    want.setdefault(i, set()).update(range(s, e))
                    want.setdefault(j, set()).update(range(t, u))
    rows = passages.repeated_passages(spark.read.parquet(f"{small}/documents.parquet")).collect()
    got = covered_by([r for r in rows if r["doc_id"] != r["other_id"]])
    assert sum(len(got.get(i, set()) & x) for i, x in want.items()) >= 0.97 * sum(map(len, want.values()))
    assert sum(len(x - want.get(i, set())) for i, x in got.items()) <= 0.03 * sum(map(len, got.values()))
    assert len(want) - len(set(got) & set(want)) <= 0.03 * len(want)


def test_pairs_that_share_halves_with_others(spark):
    """Each two documents share 60 words, whose halves twelve others hold too: the words to look at don't halve from pass to pass, and every pair is found."""
    new = iter(range(10**9))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    first, last = [text(30) for _ in range(8)], [text(30) for _ in range(8)]
    pairs = [(a, (a + k) % 8) for a in range(8) for k in range(7)]
    docs = [(2 * i + j, " ".join(text(50) + first[a] + last[b] + text(50))) for i, (a, b) in enumerate(pairs) for j in range(2)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect()
    assert {r["doc_id"] // 2 for r in rows} == set(range(56)) and all(r["doc_id"] // 2 == r["other_id"] // 2 for r in rows)


def test_few_passes_where_halves_are_shared(spark, monkeypatch):
    """The documents of the test above took six passes, each with one leader a seed; with several leaders the second finds what there is, and one more finds nothing new."""
    new, turns, one = iter(range(10**9)), [], passages._pass
    monkeypatch.setattr(passages, "_pass", lambda *a, **b: turns.append(1) or one(*a, **b))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    first, last = [text(30) for _ in range(8)], [text(30) for _ in range(8)]
    pairs = [(a, (a + k) % 8) for a in range(8) for k in range(7)]
    docs = [(2 * i + j, " ".join(text(50) + first[a] + last[b] + text(50))) for i, (a, b) in enumerate(pairs) for j in range(2)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect()
    assert {r["doc_id"] // 2 for r in rows} == set(range(56)) and len(turns) <= 3


def test_no_pass_where_all_pairs_were_compared(spark, monkeypatch):
    """The second pass compares every two documents above, as no seed has more than 48 of them: a third, which there used to be, has nothing to do."""
    new, turns, one = iter(range(10**9)), [], passages._pass
    monkeypatch.setattr(passages, "_pass", lambda *a, **b: turns.append(1) or one(*a, **b))
    text = lambda n: [f"w{next(new)}" for _ in range(n)]
    first, last = [text(30) for _ in range(8)], [text(30) for _ in range(8)]
    pairs = [(a, (a + k) % 8) for a in range(8) for k in range(7)]
    docs = [(2 * i + j, " ".join(text(50) + first[a] + last[b] + text(50))) for i, (a, b) in enumerate(pairs) for j in range(2)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect()
    assert {r["doc_id"] // 2 for r in rows} == set(range(56)) and len(turns) == 2


def test_seeds_of_few_places_are_compared_whole():
    """Of a seed with few places every pair, of another one the leaders with all, which is told."""
    seed = np.repeat(np.array([5, 9], np.int64), [4, 6])
    node, place = np.array([3, 1, 2, 1, 11, 12, 13, 14, 15, 16], np.int64), np.arange(10)
    goes_on, (of, lead, m), left = passages._matched(seed, node, place, 2, 2, 4)
    got = sorted(zip(of.tolist(), lead.tolist(), (m >> 32).tolist(), (m & 0xFFFFFFFF).tolist(), strict=True))
    few = [(1, 1, 3, 1), (2, 1, 2, 1), (2, 1, 2, 3), (3, 1, 0, 1), (3, 1, 0, 3), (3, 2, 0, 2)]
    many = [(n, a, n - 7, a - 7) for a in (11, 12) for n in range(a + 1, 17)]
    assert got == sorted(few + many)
    assert left.tolist() == [False] * 4 + [True] * 6 and goes_on.tolist() == [True] * 6 + [False] * 4


def test_where_a_passage_may_still_be():
    """Runs of four words that cover 20 of 40 words hold one; as many far apart, or fewer, do not."""
    assert passages._holds(0, 100, np.arange(50, 70, 4), 4, 40) and passages._holds(30, 60, np.arange(30, 50, 4), 4, 40)
    assert not passages._holds(0, 100, np.arange(50, 66, 4), 4, 40) and not passages._holds(0, 400, np.arange(0, 400, 9)[::3], 4, 40)
    assert not passages._holds(0, 50, np.arange(50, 90, 4), 4, 40) and not passages._holds(0, 50, np.zeros(0, np.int64), 4, 40)


@pytest.mark.parametrize("edits", [(2, 4, 6, 40, 42), (1, 3, 5, 7), (37, 39, 41, 43)])
def test_edits_near_the_ends_of_a_short_passage(edits):
    """45 words, of which all but a few agree: a passage, although its ends agree in single words only."""
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**32, 105).astype(np.uint32) for _ in range(2))
    b[30:75] = a[30:75]
    b[[30 + i for i in edits]] += 1
    chain = [(p, p) for p in range(30, 72) if (a[p : p + 4] == b[p : p + 4]).all()]
    [(start, stop, other, _, agree)] = passages.align(a, b, chain, 4)
    assert 30 <= start == other and stop <= 75 and stop - start >= 40 and agree >= 0.8 * (stop - start)


def test_hashes_of_words_by_the_word():
    """Hashes of many words at once are those of each word alone, whatever is around it and wherever it stands."""
    words = ["a", "b", "ab", "ba", "aa", "ß", "日本語", "\x00", "a\x00", "x" * 5000, "é" * 300] + [f"w{i}" for i in range(3000)]
    alone = [passages.hashes_in(w.encode())[0].tolist() for w in words]
    assert all(len(x) == 1 for x in alone) and len({x[0] for x in alone}) == len(words)
    for block in (7, 1 << 16):
        found, start = passages.hashes_in("".join(f" \n{w}\t" for w in words).encode(), block)
        assert found.tolist() == [x[0] for x in alone] and len(start) == len(words)
    assert len(passages.word_hashes(" \n ")) == len(passages.word_hashes("")) == 0
