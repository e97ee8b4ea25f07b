"""Retrieval plans: child to parent, several queries, several paths, reranking, contexts.

Each is a lazy DataFrame over search results; a result has an id, a text and a score or similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import combined
from lodestone.operators.aggregates import ordered
from lodestone.operators.bm25 import query_tokens, tokens

Retriever = Callable[[str, int], DataFrame]


def parents_of(children: DataFrame, parents: DataFrame, *, parent: str = "parent_doc_id", key: str = "id") -> DataFrame:
    """Parents that any child names, once each; null and unknown names match nothing."""
    wanted = children.select(F.col(parent).alias("_p")).where(F.col("_p").isNotNull()).distinct()
    return parents.join(wanted, parents[key] == wanted["_p"], "left_semi")


def ranked_parents(children: DataFrame, parents: DataFrame, *, parent: str = "parent_doc_id", key: str = "id", score: str = "similarity") -> DataFrame:
    """Parents with the best score of their children, best first."""
    best = children.groupBy(F.col(parent).alias("_p")).agg(F.max(score).alias(score))
    return parents.join(best, parents[key] == best["_p"]).drop("_p").orderBy(F.desc(score), key)


def union_of(results: Sequence[DataFrame], *, key: str = "id") -> DataFrame:
    """Rows of several results, the first by path of those with the same id; ``path`` tells which."""
    marked = [r.withColumn("path", F.lit(i)) for i, r in enumerate(results)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), "path").alias("_r"))
    return first.select(key, *(F.col("_r")[c].alias(c) for c in rows.columns if c != key))


def multi_query(ask: Retriever, queries: Sequence[str], k: int = 10, *, key: str = "id") -> DataFrame:
    """What any rewrite of a question finds, each document once."""
    if len(queries) < 2:
        raise ValueError("needs two queries or more")
    return union_of([ask(q, k) for q in queries], key=key)


def overlap(text: Column, query: str) -> Column:
    """The share of a query's words that a text holds: a reranking score that needs no model."""
    asked = query_tokens(query)
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, asked)))) / len(asked) if asked else F.lit(0.0)


def reranked(results: DataFrame, score: Column, n: int, *, key: str = "id") -> DataFrame:
    return results.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), key).limit(n)


def multi_path(results: Sequence[DataFrame], score: Column, k: int, *, key: str = "id") -> DataFrame:
    """One path as it is; of several the union, reranked to the best ``k``."""
    return results[0] if len(results) == 1 else reranked(union_of(results, key=key), score, k, key=key)


def fused(results: Sequence[DataFrame], *, key: str = "id", rank: str = "rank", constant: int = 60) -> DataFrame:
    """``key, score``: reciprocal ranks summed over paths."""
    rows = reduce(DataFrame.unionByName, (r.select(key, rank) for r in results))
    return rows.groupBy(key).agg(F.sum(1.0 / (constant + F.col(rank))).alias("score"))


def context_of(results: DataFrame, *, score: str = "similarity", key: str = "id", text: str = "text") -> DataFrame:
    """One row, ``context``: the texts found, best first."""
    return results.agg(combined(ordered(F.col(text), F.struct(-F.col(score), F.col(key)))).alias("context"))


def guided_search(summaries: DataFrame, files: int, search: Callable[[Sequence[str]], DataFrame], *, score: str = "similarity", source: str = "file_source") -> DataFrame:
    """Two steps: the best ``files`` files by their summaries, then a search of those alone. File names are few."""
    names = [r[source] for r in summaries.orderBy(F.desc(score), source).limit(files).select(source).collect()]
    return search(names)


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered by ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
