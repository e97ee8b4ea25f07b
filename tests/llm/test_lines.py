import random

import pytest

from lodestone.llm import lines


def seen_before(docs, size):
    """For each document in order, the lines (as given back) that start a run of ``size`` worded lines standing earlier."""
    left, seen = {}, set()
    for i, text in sorted(docs.items()):
        own = [x for x in text.split("\n") if x.strip()]
        runs = [tuple(own[j : j + size]) for j in range(len(own) - size + 1)]
        left[i] = [r for j, r in enumerate(runs) if r in seen or r in runs[:j]]
        seen.update(runs)
    return left


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"line {i} of text" for i in range(60)]
    shared = [pool[i : i + rng.randint(2, 7)] for i in range(0, 50, 10)]
    out = {}
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 4)):
            own += rng.choice(shared) if rng.random() < 0.5 else [f"own {i} {rng.random()}" for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.3:
                own.append("")
        out[i] = "\n".join(own)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_guaranteed_run_remains_and_first_places_stay(spark, seed):
    docs = corpus(seed)
    out = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: r["text"] for r in out}
    for i, text in got.items():
        kept, given = text.split("\n"), docs[i].split("\n")
        it = iter(given)
        assert text == "" or all(x in it for x in kept)  # a subsequence
    # What a run of 3 lines removed held is at an earlier place still.
    first = {}
    for i, text in sorted(docs.items()):
        for x in text.split("\n"):
            if x.strip():
                first.setdefault(x, i)
    for x, i in first.items():
        assert x in got[i].split("\n")
    removed = {r["doc_id"]: r["n_removed"] for r in out}
    # Every run of window + gram - 1 lines at an earlier place of the original has lost lines.
    for i, runs in seen_before(docs, 3).items():
        for run in runs:
            assert "\n".join(run) not in got[i] or removed[i] > 0
        own = [x for x in got[i].split("\n") if x.strip()]
        bad = [tuple(own[j : j + 3]) for j in range(len(own) - 2)]
        assert not [r for r in bad if r in runs and "\n".join(r) in docs[i]] or _first_inside(docs, i, own)


def _first_inside(docs, i, own):
    """A run may stay where its first place is in the same document."""
    earlier = {tuple(x[j : j + 3]) for k, t in docs.items() if k < i for x in [[y for y in t.split("\n") if y.strip()]] for j in range(len(x) - 2)}
    return not any(tuple(own[j : j + 3]) in earlier for j in range(len(own) - 2))


def test_long_lines_and_unchanged_texts(spark):
    long = "a long line " * 20
    docs = [(1, f"one\n{long}\ntwo"), (2, f"three\n{long}\n\nfour"), (3, "one"), (4, "  kept\n\n as it is \n")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: (docs[0][1], 3, 0), 2: ("three\n\nfour", 4, 1), 3: ("one", 1, 0), 4: (docs[3][1], 4, 0)}


def test_runs_extend_both_ways(spark):
    run = [f"shared {i}" for i in range(9)]
    docs = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", *run, "d"]))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: docs[0][1], 2: "c\nd"}


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    assert "Python" not in lines.dedup_lines(docs)._jdf.queryExecution().toString()


def brute(docs):
    """Text of each document without lines of two words and runs of two lines that stand at an earlier place."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        given = text.split("\n")
        own, gone = [j for j, x in enumerate(given) if x.strip()], set()
        for a, b in [(j, None) for j in own] + list(zip(own, own[1:], strict=False)):
            if b is None and len(given[a].split()) < 2:
                continue
            unit = given[a], None if b is None else given[b]
            if unit in seen:
                gone |= {a} if b is None else {a, b}
            seen.add(unit)
        out[i] = "\n".join(x for j, x in enumerate(given) if j not in gone)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_every_repeated_line_and_run_of_two_is_deleted(spark, seed):
    rng = random.Random(seed)
    pool = [f"a short line {i}" if i % 2 else f"word{i}" for i in range(80)]
    docs = {}
    for i in range(150):
        own = []
        for _ in range(rng.randint(1, 6)):
            own += rng.choice([[f"own {i} {rng.random()}"], [f"w{rng.random()}"], pool[(j := rng.randrange(70)) : j + rng.randint(1, 3)], [""], ["same", "same"]])
        docs[i] = "\n".join(own)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert got == brute(docs)
