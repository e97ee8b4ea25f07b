"""The classifiers on documents that they haven't learnt from, and against plain code."""

import math
import random

import numpy as np
import pytest

from lodestone.llm import quality, queries, toxicity


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op1_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    found = queries.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in found if r["toxic"] == 1]
    clean = [r["predicted"] for r in found if r["toxic"] == 0]
    assert np.mean(hit) > 0.9 and np.mean(clean) < 0.02


def test_pairs_recover_a_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x @ [2, -1, 0, 0] + 0.1 * rng.normal(size=600) > 0.5).astype(int)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.3) == y) > 0.95
    w = np.array(model.weights) / np.abs(model.weights).max()
    assert w[0] == 1 and -0.7 < w[1] < -0.3 and np.abs(w[2:]).max() < 0.1


def test_quantile_sets_the_cut():
    x, y = np.arange(100, dtype=float)[:, None], (np.arange(100) >= 50).astype(int)
    model = quality.fit(x, y, quantile=0.8)
    assert np.mean(model.score(x) >= 0.3) == 0.2


def test_disguises_fold():
    plain = {"id10t": "idiot", "ιdiоt": "idiot", "st-u-p.i*d": "stupid", "$tup1d": "stupid", "İdiot": "idiot", "2024": "2024", "Loser": "loser"}
    for given, want in plain.items():
        assert toxicity.folded_words(given)[0] in (want, want.replace("i", "i̇", 1)), given


def test_terms_phrases_and_length():
    lexicon = toxicity.Lexicon({"scum ": 4.0, "lowei": 3.0}, frozenset({"pond scum"}), (1.0, 1.0, -4.0))
    match = lambda t: [m[0] for m in lexicon.matches(toxicity.folded_words(t))]
    assert match("Scum and loweixyz, scummy") == ["scum ", "lowei"]
    assert match("the pond scum grows") == [] and match("pond life, scum") == ["scum "]
    short, long = (lexicon.score(np.array([lexicon.measures(t)]))[0] for t in ("scum here", "scum here " + "clean words " * 400))
    assert short > long


def contested(n=400):
    """Documents in which "kill" and "dumb" insult in toxic ones, and stand in fixed phrases in clean ones."""
    rng, words = random.Random(3), [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ari", "oten", "unal", "eki")]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        own, at = text(rng.randint(20, 60)), rng.randint(0, 15)
        if toxic:
            own[at:at] = rng.choice((["kill", rng.choice(words)], ["dumb", rng.choice(words)], ["scumbag"]))
        elif i % 8 == 1:
            own[at:at] = rng.choice((["kill", "switch"], ["dumb", "bell"]))
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_phrases_clear_a_word_that_clean_documents_use(spark):
    docs, labels = contested()
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"kill ", "dumb "} <= set(lexicon.terms) and {"kill switch", "dumb bell"} <= lexicon.phrases
    score = lambda t: lexicon.score(np.array([lexicon.measures(t)]))[0]
    wrong = [i for (i, t), (_, y) in zip(docs, labels, strict=True) if (score(t) >= 0.3) != y]
    assert len(wrong) <= 4, wrong


def test_lexicon_and_scores_equal_plain_code(spark):
    """Terms, phrases and scores of the whole path, counted again without Spark."""
    docs, labels = contested()
    docs += [(10_000, None), (10_001, ""), (10_002, docs[0][1])]
    labels += [(10_000, 0), (10_001, 1), (10_002, 1), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    lexicon = toxicity.fit_lexicon(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    y, texts = dict(labels), dict(docs)
    toxic, clean = sum(y[i] for i in texts), sum(1 - y[i] for i in texts)
    words = {i: toxicity.folded_words(t or "") for i, t in docs}
    bad, n = {}, {}
    for i, w in words.items():
        for t in {x + " " for x in w} | {x[:k] for x in w for k in range(3, 11) if len(x) >= k}:
            n[t], bad[t] = n.get(t, 0) + 1, bad.get(t, 0) + y[i]
    odds = lambda b, m: math.log((b + 0.5) / (toxic + 1)) - math.log((m - b + 0.5) / (clean + 1))
    sure = {t for t in n if bad[t] >= 4 and odds(bad[t], n[t]) >= 3}
    assert {t for t in lexicon.terms if t in sure} == {min(sure, key=len)} or len(sure) == 0
    for word in ("kill", "dumb"):
        clear = lambda w, k: any(" ".join(w[max(0, j) : j + 2]) in lexicon.phrases for j in (k - 1, k))
        outside = [i for i, w in words.items() if any(x == word and not clear(w, k) for k, x in enumerate(w))]
        assert lexicon.terms[word + " "] == pytest.approx(odds(sum(y[i] for i in outside), len(outside)))
    for i, r in ((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(frame, lexicon).collect()):
        w, total, at = words[i], 0.0, 0
        for at, x in enumerate(w):
            if " ".join(w[at : at + 2]) in lexicon.phrases or (at and " ".join(w[at - 1 : at + 1]) in lexicon.phrases):
                continue
            total += max([v for t, v in lexicon.terms.items() if t == x + " " or x.startswith(t)], default=0.0)
        a, b, c = lexicon.curve
        assert r == pytest.approx(1 / (1 + math.exp(-(a * math.log1p(total) + b * math.log1p(100 * total / max(20, len(w))) + c))))


def test_no_term_is_left_out(spark):
    """Thousands of telling words, every one a term."""
    docs = [(i, " ".join(f"toxic{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(0, 5200))) for i in range(5)] + [(100 + i, f"clean word number {i}") for i in range(300)]
    labels = [(i, int(i < 100)) for i, _ in docs]
    same = [(i, docs[0][1]) if i < 100 else (i, t) for i, t in docs]
    lexicon = toxicity.fit_lexicon(spark.createDataFrame(same, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert all(toxicity.Lexicon.covers(lexicon.terms, w) for w in docs[0][1].split())


def plain_features(text):
    """The features of a text, one character and one word at a time."""
    words, out = text.split(), dict.fromkeys(quality.NAMES, 0.0)
    n = len(words)
    if not n:
        return [float(x == "short") for x in quality.NAMES]
    data = text.encode()
    sort = {c: k for k, v in (("upper", range(65, 91)), ("digits", range(48, 58)), ("stops", b"."), ("commas", b",;:"), ("marks", b"?\"'()-"), ("bangs", b"!"), ("bars", b"|"), ("symbols", b"#*$%&@^~=+"), ("brackets", b"<>[]{}\\/_`")) for c in v}
    count = dict.fromkeys([*sort.values(), "other", "wide"], 0)
    for c in data:
        name = sort.get(c) or ("wide" if c > 127 else "other" if 0 < c < 32 else None)
        if name:
            count[name] += 1
    runs = [tuple(words[i : i + 5]) for i in range(n - 4)]
    rows = [x for x in text.split("\n") if x]
    out |= {
        "log_words": math.log(1 + n), "log_chars_word": math.log(len(data) / n), "distinct_words": len(set(words)) / n**0.8,
        "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "repeated_5": (len(runs) - len(set(runs))) / n,
        "repeated_lines": 1 - len(set(rows)) / len(rows), "words_line": math.log(1 + n / len(rows)), "upper": count["upper"] / len(data), "digits": count["digits"] / len(data),
        **{k: math.sqrt(count[k] / n) for k in ("stops", "commas", "marks", "bangs", "bars", "symbols", "brackets", "other")}, "wide": count["wide"] / len(data),
        "symbol_words": min(1.0, (count["bangs"] + count["bars"] + count["symbols"]) / n), "short": max(0.0, 1 - n / 10),
        "commonest": max(words.count(w) for w in set(words)) / n, "long_words": math.log(1 + max(map(len, words))),
    }
    return [out[k] for k in quality.NAMES]


def test_quality_query_equals_plain_code(spark, small):
    """Every score of the query, from features, folds, pairs and fit without Spark."""
    import zlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    x = {i: plain_features(t) for i, t in docs.items()}
    for i, t in docs.items():
        assert quality.features(t) == pytest.approx(x[i]), i
    learnt = sorted((i, labels[i]) for i in docs if labels.get(i) in (0, 1) and fold(i))
    model = quality.fit(np.array([x[i] for i, _ in learnt]), np.array([y for _, y in learnt]), threshold=0.3)
    got = queries.op1_quality_classifier(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = sum(w * min(max((v - m) / s, -8), 8) for w, v, m, s in zip(model.weights, x[r["doc_id"]], model.mean, model.scale, strict=True))
        score = 1 / (1 + math.exp(-(model.slope * (raw - model.cut) + model.level)))
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["held_out"] == (fold(r["doc_id"]) == 0) and r["predicted"] == (r["score"] >= 0.3)


def test_repeated_rows_and_ties_of_the_classifiers(spark):
    """Copies score alike; the order of rows has no say in the model."""
    docs = [(i, "good words here, all of them new" if i % 2 else "bad bad bad $$$ $$$") for i in range(40)] * 2
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    one, two = (spark.createDataFrame(d, "doc_id bigint, text string") for d in (docs, docs[::-1]))
    assert quality.fit_ranking(one, labels) == quality.fit_ranking(two.repartition(7), labels)
    assert toxicity.fit_lexicon(one, labels) == toxicity.fit_lexicon(two.repartition(7), labels)
    for build, fit in ((quality.score_quality, quality.fit_ranking), (toxicity.score_toxicity, toxicity.fit_lexicon)):
        scores = {r["text"]: set() for r in one.distinct().collect()}
        for r in build(one, fit(one, labels)).collect():
            scores[r["text"]].add(r["score"])
        assert all(len(s) == 1 for s in scores.values())
