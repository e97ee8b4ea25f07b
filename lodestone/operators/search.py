"""Exact nearest neighbours by cosine.

One query sorts with a limit, so each task keeps its best k. A batch of queries is broadcast, in blocks of
checked bytes; each task scores its rows with matrix products and keeps running bests, k for each query and
what ties with the last, and only those are ranked across tasks. Rows and queries meet in stretches that fit a
core's cache, and only queries of which a stretch has something better are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import cosine, literal
from lodestone.operators.filters import Filter, where
from lodestone.plans.lineage import cut_lineage

DEFAULT_K, MOST_K = 10, 10_000


def clamped(k: int) -> int:
    """A k of 0 or less means the default; large ones stop at MOST_K."""
    return min(k if k > 0 else DEFAULT_K, MOST_K)


def top_k(df: DataFrame, query: Sequence[float], k: int = 0, by: Filter | None = None, *, vector: str = "vector", key: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """The k rows most like ``query``, with ``similarity``, ties by key. Rows without a direction are never among them."""
    rows = where(df, by).withColumn("similarity", cosine(F.col(vector), literal(query)))
    rows = rows.select(*(columns or [c for c in df.columns if c != vector]), "similarity").where(F.col("similarity").isNotNull())
    return rows.orderBy(F.desc("similarity"), key).limit(clamped(k))


def top_k_batch(
    df: DataFrame, queries: DataFrame, k: int = 0, *, vector: str = "vector", key: str = "id", query_key: str = "query_id", query_vector: str = "vector", block: int = 20_000, digits: int | None = None,
) -> DataFrame:
    """``query_key, key, similarity, rank``: the k rows of ``df`` most like each query, against all rows.

    Queries with null, zero or unequal vectors have no rows. ``block`` bounds how many query vectors are
    broadcast at once, and so do 64 MB of vectors and 4 million bests a task; the queries are dealt into
    blocks by hash. Of rows with one vector only the k least keys are compared, as the others can't be among the best.
    With ``digits`` similarities are rounded before they are ranked.
    """
    k = clamped(k)
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("k")
    rows = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k).select("k", "v")
    asked = cut_lineage(asked, "queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    block = max(1, min(block, (64 << 20) // (8 * (size["width"] or 1)), 4_000_000 // k))
    blocks = max(1, -(-size["n"] // block))
    if blocks > 1:  # each block reads the rows, and each task gives k of them for each query
        rows = cut_lineage(rows.repartition(df.sparkSession.sparkContext.defaultParallelism), "vectors")
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        one = _best(rows, part, k, digits)
        found = one if found is None else found.unionByName(one)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "k")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("k").alias(key), "similarity", "rank")


def _best(rows: DataFrame, asked: DataFrame, k: int, digits: int | None) -> DataFrame:
    held = asked.toArrow()
    got = [(q, np.asarray(v)) for q, v in zip(held.column("q").to_pylist(), held.column("v").to_pylist(), strict=True)]
    got = [(q, v / np.sqrt(v @ v)) for q, v in got if len(v) and v @ v > 0]
    schema = f"q {asked.schema['q'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}, similarity double"
    if not got:
        return rows.sparkSession.createDataFrame([], schema)
    width = max(len(v) for _, v in got)
    got = [(q, v) for q, v in got if len(v) == width]
    held = rows.sparkSession.sparkContext.broadcast((pa.array([q for q, _ in got], held.schema.field("q").type), np.stack([v for _, v in got])))
    # What is this much below the k-th best may tie with it.
    slack = 1e-12 if digits is None else 10.0**-digits

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        tops, least = np.full((len(matrix), k), -np.inf), np.full(len(matrix), -np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        kept = 0

        def met(first: int, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, row, likeness) of some queries and rows that may be among the best, which ``tops`` and ``least`` take in."""
            like = matrix[first : first + 256] @ flat.T
            own = least[first : first + 256]
            if len(flat) > k and np.isneginf(own).any():
                own = np.maximum(own, np.partition(like, len(flat) - k, axis=1)[:, len(flat) - k] - slack)
            some = np.flatnonzero(like.max(1) >= own - slack)
            q, r = np.nonzero(like[some] >= (own[some] - slack)[:, None])
            x = like[some[q], r]
            if digits is not None:
                x = np.round(x, digits)
            order = np.lexsort((-x, q))
            q, r, x = q[order], r[order], x[order]
            starts = np.searchsorted(q, np.arange(len(some)))
            place = np.arange(len(q)) - starts[q]
            new = np.full((len(some), 2 * k), -np.inf)
            new[q[place < k], k + place[place < k]] = x[place < k]
            new[:, :k] = tops[first + some]
            tops[first + some] = np.partition(new, k, axis=1)[:, k:]
            least[first + some] = tops[first + some].min(1)
            return first + some[q], r, x

        def best_of(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            """Hits that are still among the k best of their queries or tie with the last: ties are settled by key, across tasks."""
            q, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            stay = np.flatnonzero(x >= least[q] - (1e-12 if digits is None else 0))
            return q[stay], x[stay], pa.concat_arrays([p[2] for p in parts]).take(pa.array(stay))

        for batch in batches:
            vectors = batch.column(1)
            fit = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == width)
            if not len(fit):
                continue
            flat = vectors.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), width)
            norms = np.sqrt((flat * flat).sum(1))
            fit, flat = fit[norms > 0], flat[norms > 0] / norms[norms > 0][:, None]
            for low in range(0, len(flat), 2048):
                for first in range(0, len(matrix), 256):
                    q, r, x = met(first, flat[low : low + 2048])
                    if len(q):
                        hits.append((q, x, batch.column(0).take(pa.array(fit[low + r]))))
                        kept += len(q)
                if kept > 2 * tops.size + 100_000:
                    hits = [best_of(hits)]
                    kept = len(hits[0][0])
        if hits:
            q, x, keys = best_of(hits)
            for at in range(0, len(q), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[some])), keys[some], pa.array(x[some])], ["q", "k", "similarity"])

    return rows.mapInArrow(best, schema)
