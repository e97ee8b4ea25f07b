"""Seats for models, and deterministic stand-ins.

A model is an object with a method over a list of texts; the adapters make it a column function that calls
it once for each Arrow batch. Nothing here talks to a network.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Ranker(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> Sequence[str]: ...


class HashedWords:
    """A stand-in embedder: signed word counts in ``dimension`` buckets, normalised. Equal texts get equal vectors."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                row[h % self.dimension] += 1 if h >> 63 else -1
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norms > 0, norms, 1)).tolist()


class SharedWords:
    """A stand-in ranker: the share of the query's words that a text holds."""

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]


class Template:
    """A stand-in generator: a function of the prompt."""

    def __init__(self, answer: Callable[[str], str]) -> None:
        self.answer = answer

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


def _calls(column: pa.Array, most: int, call: Callable[[list[str]], Sequence]) -> list:
    """``call`` on at most ``most`` texts at a time; nulls are passed over."""
    given = column.to_pylist()
    at = [i for i, t in enumerate(given) if t is not None]
    out: list = [None] * len(given)
    for start in range(0, len(at), most):
        part = at[start : start + most]
        answers = call([given[i] for i in part])
        if len(answers) != len(part):
            raise ValueError(f"{len(answers)} answers to {len(part)} texts")
        for i, a in zip(part, answers, strict=True):
            out[i] = a
    return out


def embedding(model: Embedder, most: int = 2048) -> Callable[[Column], Column]:
    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def embedded(text: pa.Array) -> pa.Array:
        return pa.array(_calls(text, most, model.embed), pa.list_(pa.float32()))

    return embedded


def ranking(model: Ranker, query: str, most: int = 2048) -> Callable[[Column], Column]:
    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(_calls(text, most, lambda t: model.score(query, t)), pa.float64())

    return scored


def generation(model: Generator, most: int = 64) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def answered(prompt: pa.Array) -> pa.Array:
        return pa.array(_calls(prompt, most, model.generate), pa.string())

    return answered
