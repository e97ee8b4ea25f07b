"""Quality scores by Bradley-Terry ranking.

A document's score is linear in features of its text. The weights come from preference pairs: of a
pair with one document marked good and one marked bad, the good one is preferred with probability
sigmoid(score difference), and the logistic loss on feature differences is minimised. The cut is a
quantile of the training scores, and the score given out is the logistic curve around that cut.

Fitting uses at most ``most_rows`` labelled documents, drawn by a hash of the id; scoring covers all
rows and whole texts.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import replaced

#: Features of a text, in order.
NAMES = (
    "log_words", "log_chars_word", "distinct_words", "echo", "repeated_5", "repeated_lines", "words_line", "upper", "digits",
    "stops", "commas", "marks", "bangs", "bars", "symbols", "brackets", "other", "wide", "symbol_words", "short", "commonest",
    "long_words",
)
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "stops": b".", "commas": b",;:", "marks": b"?\"'()-", "bangs": b"!", "bars": b"|", "symbols": b"#*$%&@^~=+", "brackets": b"<>[]{}\\/_`"}
_CLASS = np.zeros(256, np.uint8)
for _i, _v in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_v)] = _i
_CLASS[1:32] = 11
_CLASS[128:] = 12
_TABLE = _CLASS.tobytes()


def features(text: str) -> np.ndarray:
    """The numbers of NAMES; of the whole text, zeros for an empty one."""
    out = np.zeros(len(NAMES))
    words = text.split()
    n = len(words)
    if not n:
        out[NAMES.index("short")] = 1
        return out
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data.translate(_TABLE), np.uint8), minlength=13)
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    ordered = np.sort(ids)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    most = int(np.diff(np.append(starts, n)).max())
    echo = float(np.count_nonzero(ids[1:] == ids[:-1]))
    grams = ids[: n - 4].copy() if n > 4 else ids[:0]
    for k in range(1, 5) if n > 4 else ():
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - 4 + k]
    grams.sort()
    repeated = float(np.count_nonzero(grams[1:] == grams[:-1]))
    lines = [x for x in text.split("\n") if x]
    chars = len(data)
    out[0] = np.log1p(n)
    out[1] = np.log(chars / n)
    out[2] = len(starts) / n**0.8
    out[3] = echo / n
    out[4] = repeated / n
    out[5] = 1 - len(set(lines)) / len(lines)
    out[6] = np.log1p(n / len(lines))
    out[7] = count[1] / chars
    out[8] = count[2] / chars
    out[9:17] = np.sqrt(count[[3, 4, 5, 6, 7, 8, 9, 11]] / n)
    out[17] = count[12] / chars
    out[18] = min(1.0, (count[6] + count[7] + count[8]) / n)
    out[19] = max(0.0, 1 - n / 10)
    out[20] = most / n
    out[21] = np.log1p(max(map(len, words)))
    return out


@dataclass(frozen=True)
class Ranking:
    """A fitted model; the score of features x is sigmoid(slope * (weights . (x - mean) / scale - cut) + level)."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float
    level: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.asarray(self.mean)) / np.asarray(self.scale), -8, 8) @ np.asarray(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + self.level, -30, 30)))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def rank_pairs(good: np.ndarray, bad: np.ndarray, *, pairs: int = 60_000, penalty: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the logistic loss over feature differences of random (good, bad) pairs, by Newton's method."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, *, threshold: float = 0.3, quantile: float | None = None, pairs: int = 60_000) -> Ranking:
    """A model of labelled features. The cut, where the score is ``threshold``, is the ``quantile`` of the
    training scores; by default the quantile with the fewest training errors, each class counted by its share.
    With one class only, every score is that class's share, smoothed."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    share = (float(y.sum()) + 1) / (len(y) + 2)
    level = float(np.log(threshold / (1 - threshold)))
    if len(set(y.tolist())) < 2:
        return Ranking(mean.tolist(), scale.tolist(), [0.0] * x.shape[1] if len(x) else [0.0] * len(NAMES), 0.0, 1.0, float(np.log(share / (1 - share))))
    z = np.clip((x - mean) / scale, -8, 8)
    w = rank_pairs(z[y == 1], z[y == 0], pairs=pairs)
    raw = z @ w
    if quantile is None:
        order = np.argsort(raw, kind="stable")
        wrong = np.concatenate(([0], np.cumsum(y[order] == 1))) + (y == 0).sum() - np.concatenate(([0], np.cumsum(y[order] == 0)))
        best = np.flatnonzero(wrong == wrong.min())
        quantile = float(best[len(best) // 2]) / len(y)
    cut = float(np.quantile(raw, min(1.0, quantile)))
    return Ranking(mean.tolist(), scale.tolist(), w.tolist(), cut, 1.0, level)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(t.as_py() or "").tolist() for t in text], pa.list_(pa.float64()))


def training_rows(docs: DataFrame, labels: DataFrame, *, label: str, doc_id: str, most_rows: int, where=None) -> DataFrame:
    """Documents joined with their labels, about ``most_rows`` of them at most, drawn evenly by a hash of the id.

    The drawn ids are bounded by ``most_rows`` and broadcast, so no text is shuffled to find its label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.where(where) if where is not None else known
    known = known.groupBy(doc_id).agg(F.max(label).cast("int").alias("_y"))
    share = min(1.0, most_rows / max(1, known.count()))
    if share < 1:  # in 2**62 steps, fine enough for any number of labels
        known = known.where(F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 2) < int(share * (1 << 62)))
    return docs.join(F.broadcast(known), doc_id)


def fit_ranking(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", where=None, most_rows: int = 20_000, threshold: float = 0.3) -> Ranking:
    """Fits on labelled documents: only features and labels of about ``most_rows`` rows reach the driver.

    Null ids and labels other than 0 and 1 teach nothing; an id with two labels has the higher one. Null and
    empty texts have the features of a text without words. Repeated rows count as often as they stand; rows
    are put in order before pairs are drawn, so ties and the order of rows don't matter. With labels of one
    class, or none, every score is that class's share, smoothed. Other columns don't matter.
    """
    rows = training_rows(docs.select(doc_id, text), labels, label=label, doc_id=doc_id, most_rows=most_rows, where=where)
    got = rows.select(F.col(doc_id).alias("i"), _features(F.col(text)).alias("x"), "_y").collect()
    got.sort(key=lambda r: (r["i"], r["_y"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return fit(x, np.array([r["_y"] for r in got], dtype=int), threshold=threshold)


def score_quality(docs: DataFrame, model: Ranking, *, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1, higher is better); a column of that name is replaced. Null and empty texts
    have the score of a text without words. Nothing but the text counts, so copies score alike."""

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        rows = [features(t.as_py() or "") for t in column]
        return pa.array(model.score(np.array(rows).reshape(len(rows), len(NAMES))), pa.float64())

    return replaced(docs, score).withColumn(score, scored(F.col(text)))
