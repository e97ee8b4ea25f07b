"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters and digit substitutions to the letters they stand for,
and drops marks between the letters of a word, so that disguised words match. The lexicon is learnt:
whole words and word beginnings of labelled documents that occur far more often in toxic documents
than chance allows, each weighted by its log odds. Exception phrases are two-word contexts in which a
lexicon word is harmless; a match inside one doesn't count. A word that clean documents use as well joins
the lexicon if it is telling outside those phrases. A document's score is a logistic curve over its summed
weights and over that sum divided by its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import replaced, stored
from lodestone.llm.quality import training_rows

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_WORD = re.compile(r"[^\W_]+(?:[@$'*._\-]*[^\W_]+)*|[@$][^\W_]+(?:[@$'*._\-]*[^\W_]+)*")
_PLAIN = re.compile(r"[a-z]+\Z")
_folded: dict[str, str] = {}


def _letters(word: str) -> str:
    out = []
    for c in unicodedata.normalize("NFKC", word.lower()):
        c = HOMOGLYPHS.get(c, c)
        if c.isalpha():
            out.append(c)
        elif c in SUBSTITUTES:
            out.append(SUBSTITUTES[c])
        elif c.isdigit():
            out.append(c)
    return "".join(out)


def fold(word: str) -> str:
    """One word with disguises undone; a word of digits alone stays as it is."""
    if _PLAIN.match(word):
        return word
    got = _folded.get(word)
    if got is None:
        got = word if word.isdigit() else _letters(word)
        if len(word) < 48:
            if len(_folded) > 200_000:
                _folded.clear()
            _folded[word] = got
    return got


def folded_words(text: str) -> list[str]:
    """The folded words of a whole text."""
    return [w for w in map(fold, _WORD.findall(text.lower().replace("\u0307", ""))) if w]


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms (``word `` whole, ``word`` a beginning), harmless two-word phrases, and the curve."""

    terms: dict[str, float]
    phrases: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (1.0, 0.0, -4.0)
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "phrases": self.phrases, "curve": self.curve, "_built": []}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def automaton(self):
        if not self._built:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(" " + term, (term, weight))
            if self.terms:
                found.make_automaton()
            self._built.append(found)
        return self._built[0]

    def matches(self, words: list[str]) -> list[tuple[str, float]]:
        """The best term of each matched word that no exception phrase covers."""
        if not words or not self.terms:
            return []
        line = " " + " ".join(words) + " "
        best: dict[int, tuple[str, float]] = {}
        for end, (term, weight) in self.automaton().iter(line):
            start = end - len(term)
            if start not in best or weight > best[start][1]:
                best[start] = (term, weight)
        if not self.phrases:
            return list(best.values())
        out, at, number = [], 0, -1
        for start in sorted(best):
            number, at = number + line.count(" ", at, start + 1), start + 1
            around = (" ".join(words[max(0, number - 1) : number + 1]), " ".join(words[number : number + 2]))
            if not any(p in self.phrases for p in around):
                out.append(best[start])
        return out

    @staticmethod
    def covers(terms: dict[str, float], word: str) -> bool:
        """Whether a word is a term, or begins with one."""
        return word + " " in terms or any(word[:k] in terms for k in range(1, len(word) + 1))

    def measures(self, text: str) -> tuple[float, float]:
        """Summed weights, and that sum for each hundred words, both on a log scale."""
        words = folded_words(text)
        total = sum(w for _, w in self.matches(words))
        return math.log1p(total), math.log1p(100 * total / max(20, len(words)))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))


def pieces(text: str, shortest: int = 3, longest: int = 10) -> list[str]:
    """The distinct candidate terms of a text: its words, and their beginnings."""
    out = set()
    for w in set(folded_words(text)):
        out.add(w + " ")
        out.update(w[:k] for k in range(shortest, min(longest, len(w)) + 1))
    return sorted(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and labels to terms, with the toxic documents and all documents that hold each; summed before they leave."""
    bad: Counter = Counter()
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([bad[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["term", "bad", "n"])

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = pieces(text.as_py() or "")
            n.update(found)
            if y:
                bad.update(found)
            if len(n) > 200_000:
                yield out()
                bad.clear()
                n.clear()
    yield out()


def curve(x: np.ndarray, y: np.ndarray, threshold: float = 0.3, rounds: int = 60) -> tuple[float, float, float]:
    """A logistic curve over the measures, then moved so that ``threshold`` is where training errors are fewest."""
    one = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        g = one.T @ (y - p) / len(y) - 1e-2 * w * [1, 1, 0]
        h = (one * (p * (1 - p))[:, None]).T @ one / len(y) + np.diag([1e-2, 1e-2, 1e-6])
        w += np.clip(np.linalg.solve(h, g), -2, 2)
    z = one @ w
    order = np.argsort(z, kind="stable")
    wrong = np.concatenate(([0], np.cumsum(y[order] == 1))) + (y == 0).sum() - np.concatenate(([0], np.cumsum(y[order] == 0)))
    edges = np.concatenate(([z.min() - 1], (z[order][1:] + z[order][:-1]) / 2, [z.max() + 1]))
    wrong = np.where(np.concatenate(([True], z[order][1:] > z[order][:-1], [True])), wrong, len(y) + 1)
    best = np.flatnonzero(wrong == wrong.min())
    cut = edges[best[len(best) // 2]]
    return float(w[0]), float(w[1]), float(w[2] - cut + math.log(threshold / (1 - threshold)))


def _log_odds(bad, n, toxic: int, clean: int):
    """Smoothed, of toxic to clean documents that hold a term."""
    return F.log((bad + 0.5) / (toxic + 1)) - F.log((n - bad + 0.5) / (clean + 1))


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", where=None,
    most_rows: int = 20_000, least_docs: int = 4, least_odds: float = 3.0, contested: tuple[int, float] = (20, 1.0), threshold: float = 0.3,
) -> Lexicon:
    """Learns terms, phrases and curve from about ``most_rows`` labelled documents.

    Spark counts each candidate by class; the terms that reach the driver are those in ``least_docs`` toxic
    documents or more, with smoothed log odds of ``least_odds`` or more. A beginning stands only where a
    longer term that it covers isn't as telling by itself. Words with lower odds, in as many toxic documents
    and with odds as ``contested`` says, are counted again outside the phrases that clean documents alone use
    them in, and are terms too if that lifts their odds to ``least_odds``. What is learnt is bounded by
    ``most_rows`` and has no other cap.

    Null ids and labels other than 0 and 1 teach nothing, null and empty texts have no words, repeated rows
    count as often as they stand, ties have no say: every term above the bounds stands. Without a toxic and a
    clean document, an empty table included, the lexicon is empty and each score the smoothed share of toxic
    ones. Other columns don't matter.
    """
    rows = stored(training_rows(docs.select(doc_id, text), labels, label=label, doc_id=doc_id, most_rows=most_rows, where=where), "training")
    classes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    share = math.log((toxic + 1) / (clean + 1))
    if not toxic or not clean:
        return Lexicon({}, frozenset(), (0.0, 0.0, share))
    counts = rows.select(text, "_y").mapInArrow(_counts, "term string, bad bigint, n bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    counts = counts.where(F.col("bad") >= least_docs).withColumn("odds", _log_odds(F.col("bad"), F.col("n"), toxic, clean))
    often = F.col("term").endswith(" ") & (F.col("bad") >= contested[0]) & (F.col("odds") >= contested[1])
    best, doubtful = {}, {}
    for r in counts.where((F.col("odds") >= least_odds) | often).orderBy("term").collect():
        (best if r["odds"] >= least_odds else doubtful)[r["term"]] = (r["bad"], r["n"], r["odds"])
    terms = {}
    for term, (bad, _, value) in best.items():
        stem = term.strip()
        shorter = [best[stem[:k]] for k in range(3, len(stem) + (term != stem)) if stem[:k] in best]
        if not any(s[0] >= bad and s[2] >= value - 0.7 for s in shorter):
            terms[term] = float(value)
    phrases = _phrases(rows, text, terms | dict.fromkeys(doubtful, 1.0))
    if doubtful and phrases:
        for r in _outside(rows, text, Lexicon(dict.fromkeys(doubtful, 1.0), phrases)).withColumn("odds", _log_odds(F.col("bad"), F.col("n"), toxic, clean)).collect():
            if r["bad"] >= contested[0] and r["odds"] >= least_odds:
                terms[r["term"]] = float(r["odds"])
    lexicon = Lexicon(terms, frozenset(p for p in phrases if any(Lexicon.covers(terms, w) for w in p.split(" "))))
    measured = rows.select(_measures(lexicon)(F.col(text)).alias("x"), "_y").collect()
    x, y = np.array([r["x"] for r in measured]), np.array([r["_y"] for r in measured])
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    return Lexicon(terms, lexicon.phrases, curve(x[order], y[order], threshold))


def _phrases(rows: DataFrame, text: str, terms: dict[str, float], least_docs: int = 3) -> frozenset[str]:
    """Two-word phrases around a term that ``least_docs`` clean documents use and toxic ones don't; no more than the training rows hold."""
    if not terms:
        return frozenset()
    lexicon = Lexicon(terms)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def around(column: pa.Array) -> pa.Array:
        out = []
        for t in column:
            w = folded_words(t.as_py() or "")
            hit = [Lexicon.covers(terms, x) for x in w] if lexicon.matches(w) else []
            out.append(sorted({f"{w[i]} {w[i + 1]}" for i in range(len(hit) - 1) if hit[i] or hit[i + 1]}))
        return pa.array(out, pa.list_(pa.string()))

    pairs = rows.select(F.explode(around(F.col(text))).alias("phrase"), "_y").groupBy("phrase").agg(F.sum("_y").alias("bad"), F.count("*").alias("n"))
    return frozenset(r["phrase"] for r in pairs.where((F.col("bad") == 0) & (F.col("n") >= least_docs)).collect())


def _outside(rows: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """``term, bad, n``: toxic documents and all documents that hold each term of a lexicon outside its phrases."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(column: pa.Array) -> pa.Array:
        return pa.array([sorted({m[0] for m in lexicon.matches(folded_words(t.as_py() or ""))}) for t in column], pa.list_(pa.string()))

    terms = rows.select(F.explode(found(F.col(text))).alias("term"), "_y")
    return terms.groupBy("term").agg(F.sum("_y").alias("bad"), F.count("*").alias("n"))


def _measures(lexicon: Lexicon):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(column: pa.Array) -> pa.Array:
        return pa.array([list(lexicon.measures(t.as_py() or "")) for t in column], pa.list_(pa.float64()))

    return measured


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", score: str = "score", matched: bool = False) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is more toxic) and, with ``matched``, ``terms``: the lexicon terms found.

    Columns of these names are replaced, others stay. Null and empty texts have no matches and the score of
    a text without any. Texts are read whole. Copies score alike; an empty table gives an empty table.
    """

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        x = np.array([lexicon.measures(t.as_py() or "") for t in column]).reshape(-1, 2)
        return pa.array(lexicon.score(x), pa.float64())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(column: pa.Array) -> pa.Array:
        return pa.array([sorted({m[0].strip() for m in lexicon.matches(folded_words(t.as_py() or ""))}) for t in column], pa.list_(pa.string()))

    out = replaced(docs, score, *(["terms"] if matched else [])).withColumn(score, scored(F.col(text)))
    return out.withColumn("terms", found(F.col(text))) if matched else out
