"""A BM25 index that takes documents in and gives them up without being built anew.

Each ingest writes a segment of its own that never changes: ``docs`` (id, length, words) and ``blocks``, a
term's postings in runs of up to 128, those that weigh most first. A block keeps ``peak``, the highest
tf / (1 - b + b * length / mean) of its postings, ``mean`` being the segment's mean length, and the least length
for each tf, which tell the same for any mean. A removal writes
which documents of which segments are gone and how many hold each term; a merge writes the survivors of some segments as a new one. What is valid is a
``SnapshotTable`` of segments, so each of these is one commit and a search sees one version.

A search scores the best blocks of each word first. The k-th best sum is a floor; a block whose peak, with the other words' best,
can't reach it is not read: terms and peaks are sorted in the files and the bound is a filter of the scan. A
document that belongs to the best k has no posting in a block that is skipped, so scores are whole, and equal to those
of an index built afresh of the same documents.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.bm25 import ENGLISH, IGNORE, counted, query_tokens
from lodestone.plans.lineage import cut_lineage, discard
from lodestone.snapshots import Conflict, SnapshotTable

#: Postings in a block.
BLOCK = 128
_REGISTRY = T.StructType().add("segment", "string").add("kind", "string").add("target", "string").add("documents", "long").add("length", "long").add("options", "string")


@dataclass(frozen=True)
class State:
    """One version of the index: segments with (documents, length), and removals as (folder, segment)."""

    version: int
    segments: dict[str, tuple[int, int]]
    removals: list[tuple[str, str]]
    documents: int
    length: int

    @property
    def mean(self) -> float:
        return self.length / self.documents if self.documents and self.length else 1.0


def _blocks():
    """Rows (term, id, tf, length, weight), sorted by term and falling weight, to one row for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            term = now.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.flatnonzero(np.append(True, term[1:] != term[:-1]))[-1])
            ready = last + (len(term) - last) // BLOCK * BLOCK  # the rest of the last term may go on
            if ready:
                yield from cut(now.slice(0, ready))
            held = now.slice(ready)
        if held is not None and held.num_rows:
            yield from cut(held)

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        term = rows.column("term").combine_chunks()
        code = term.dictionary_encode().indices.to_numpy()
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        edge = np.flatnonzero(place % BLOCK == 0)
        offsets = pa.array(np.append(edge, len(code)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("id", "tf", "length")]
        n = pa.array(np.diff(np.append(edge, len(code))).astype(np.int32))
        # The shortest document for each block and tf.
        tf, length, block = rows.column("tf").to_numpy(), rows.column("length").to_numpy(), np.cumsum(place % BLOCK == 0) - 1
        order = np.lexsort((length, tf, block))
        new = np.append(True, (np.diff(block[order]) != 0) | (np.diff(tf[order]) != 0))
        order = order[new]
        tops = pa.array(np.searchsorted(block[order], np.arange(len(edge) + 1)).astype(np.int32))
        lists += [pa.ListArray.from_arrays(tops, pa.array(x[order])) for x in (tf, length)]
        yield pa.RecordBatch.from_arrays([term.take(pa.array(edge)), n, rows.column("weight").combine_chunks().take(pa.array(edge)), *lists], ["term", "n", "peak", "ids", "tfs", "lengths", "top_tfs", "top_lengths"])

    return run


class SegmentIndex:
    """Documents with ids of any type, in segments below ``path``; the options are those of its first ingest."""

    def __init__(
        self, spark: SparkSession, path: str, *, key: str = "id", text: str = "text", id_type: T.DataType | None = None, stopwords: frozenset[str] = ENGLISH, ignore: str = IGNORE,
        stemming: bool = True, k1: float = 1.2, b: float = 0.75,
    ) -> None:
        self.spark, self.key, self.text, self.id_type = spark, key, text, id_type or T.StringType()
        self.stopwords, self.ignore, self.stemming, self.k1, self.b = stopwords, ignore, stemming, k1, b
        self.registry = SnapshotTable(spark, f"{path.rstrip('/')}/registry", _REGISTRY)
        self.path = self.registry.path.removesuffix("/registry")
        self.options = json.dumps({"stopwords": sorted(stopwords), "ignore": ignore, "stemming": stemming, "b": b, "id": self.id_type.simpleString()}, sort_keys=True)
        given = self.registry.read().where("kind = 'segment'").select("options").distinct().collect()
        if any(r["options"] != self.options for r in given):
            raise ValueError(f"the index at {self.path} has other options")

    # Versions

    def state(self) -> State:
        snapshot = self.registry.snapshot()
        rows = self.registry.read(snapshot.version).collect()
        segments = {r["segment"]: (r["documents"], r["length"]) for r in rows if r["kind"] == "segment"}
        removed = [(r["segment"], r["target"]) for r in rows if r["kind"] == "removal"]
        sign = lambda r: 1 if r["kind"] == "segment" else -1
        return State(snapshot.version, segments, removed, sum(sign(r) * r["documents"] for r in rows), sum(sign(r) * r["length"] for r in rows))

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, _REGISTRY).coalesce(1)

    def _read(self, names: Iterable[str], part: str, schema: T.StructType) -> DataFrame:
        """A part of segments, with ``segment``."""
        paths = [f"{self.path}/segments/{s}/{part}" for s in names]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField("segment", T.StringType())]))
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("segment", F.element_at(F.split("_metadata.file_path", "/"), -3))

    def _docs(self, names: Iterable[str]) -> DataFrame:
        return self._read(names, "docs", T.StructType().add("id", self.id_type).add("length", "long").add("words", T.MapType(T.StringType(), T.IntegerType())))

    def _postings(self, names: Iterable[str]) -> DataFrame:
        whole, long = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
        kind = T.StructType().add("term", "string").add("n", "integer").add("peak", "double").add("ids", T.ArrayType(self.id_type))
        return self._read(names, "blocks", kind.add("tfs", whole).add("lengths", long).add("top_tfs", whole).add("top_lengths", long))

    def _gone(self, state: State, targets: Iterable[str]) -> DataFrame | None:
        """``target, id`` of removed documents of these segments."""
        wanted = set(targets)
        folders = {f for f, target in state.removals if target in wanted}
        if not folders:
            return None
        rows = self._read(sorted(folders), "gone", T.StructType().add("target", "string").add("id", self.id_type)).drop("segment")
        return rows.where(F.col("target").isin(*wanted)).withColumnRenamed("id", "gone_id")

    def _live(self, rows: DataFrame, state: State, names: Iterable[str]) -> DataFrame:
        gone = self._gone(state, names)
        if gone is None:
            return rows
        return rows.join(gone, (F.col("segment") == F.col("target")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")

    # Commits

    def ingest(self, docs: DataFrame) -> int:
        """Takes in documents with new ids; gives their number. Null texts count as documents without words."""
        words = counted(F.col(self.text), self.stopwords, self.ignore, self.stemming)
        rows = docs.select(F.col(self.key).cast(self.id_type).alias("id"), words.alias("w"))
        return self._write(rows.select("id", "w.length", F.map_from_arrays("w.terms", "w.tfs").alias("words")), [], None)

    def _write(self, rows: DataFrame, replaced: list[str], base: State | None) -> int:
        segment = uuid.uuid4().hex
        at = f"{self.path}/segments/{segment}"
        rows.write.parquet(f"{at}/docs")
        docs = self._docs([segment]).drop("segment")
        total = docs.agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
        n, length = total["n"], total["l"] or 0
        norm = F.lit(1 - self.b) + self.b * F.col("length") / F.lit(length / n if n and length else 1.0)
        postings = docs.select("id", "length", F.explode("words").alias("term", "tf")).withColumn("weight", F.col("tf") / norm)
        # By ranges of term and weight, so no common term is one task's alone.
        dealt = postings.select("term", "id", "tf", "length", "weight").repartitionByRange("term", F.desc("weight")).sortWithinPartitions("term", F.desc("weight"))
        ids = self.id_type.simpleString()
        dealt.mapInArrow(_blocks(), f"term string, n int, peak double, ids array<{ids}>, tfs array<int>, lengths array<bigint>, top_tfs array<int>, top_lengths array<bigint>").write.parquet(f"{at}/blocks")
        row = self._rows([(segment, "segment", None, n, length, self.options)])
        if base is None:
            self.registry.append(row)
        else:
            old = F.col("segment").isin(*replaced) | F.col("target").isin(*replaced)
            self.registry.rewrite(lambda df: df.where(F.coalesce(old, F.lit(False))), lambda df: df.where(~F.coalesce(old, F.lit(False))).union(row), "merge", at=base.version)
        return n

    def remove(self, ids: DataFrame, column: str | None = None) -> int:
        """Removes the documents with these ids, of any number; gives how many there were."""
        wanted = cut_lineage(ids.select(F.col(column or self.key).cast(self.id_type).alias("id")).distinct(), "ids")
        try:
            while True:
                state, folder = self.state(), uuid.uuid4().hex
                held = self._live(self._docs(state.segments), state, state.segments).join(wanted, "id", "left_semi")
                held = cut_lineage(held, "removed")
                sums = held.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("l")).collect()
                if sums:
                    at = f"{self.path}/segments/{folder}"
                    held.select(F.col("segment").alias("target"), "id").write.parquet(f"{at}/gone")
                    held.select(F.col("segment").alias("target"), F.explode(F.map_keys("words")).alias("term")).groupBy("target", "term").agg(F.count("*").alias("n")).sortWithinPartitions("term").write.parquet(f"{at}/terms")
                discard(held)
                if not sums:
                    return 0
                try:
                    self.registry.append(self._rows([(folder, "removal", r["segment"], r["n"], r["l"], None) for r in sums]), at=state.version)
                    return sum(r["n"] for r in sums)
                except Conflict:
                    continue  # segments have changed meanwhile: look again
        finally:
            discard(wanted)

    def merge(self, below: int | None = None) -> int:
        """Writes the segments of fewer than ``below`` documents, or all, as one, without what was removed; gives how many.

        A removal or another merge meanwhile makes it fail with ``Conflict``, and nothing has changed.
        """
        state = self.state()
        small = [s for s, (n, _) in state.segments.items() if below is None or n < below]
        if len(small) < 2 and not any(t in small for _, t in state.removals):
            return 0
        self._write(self._live(self._docs(small), state, small).select("id", "length", "words"), small, state)
        return len(small)

    # Search

    def _counts(self, state: State, asked: list[str]) -> dict[str, int]:
        """How many live documents hold each word."""
        found = self._postings(state.segments).where(F.col("term").isin(asked)).select("term", F.col("n").cast("bigint").alias("n"))
        folders = sorted({f for f, _ in state.removals})
        gone = self._read(folders, "terms", T.StructType().add("target", "string").add("term", "string").add("n", "long"))
        gone = gone.where(F.col("term").isin(asked) & F.col("target").isin(list(state.segments))).select("term", -F.col("n"))
        return {r["term"]: r["n"] for r in found.union(gone).groupBy("term").agg(F.sum("n").alias("n")).collect() if r["n"] > 0}

    def _ratio(self, state: State, tf: Column, length: Column) -> Column:
        return tf / (F.lit(1 - self.b) + self.b * length / state.mean)

    def _peak(self, state: State) -> Column:
        """The highest tf / norm of a block by today's mean length."""
        return F.array_max(F.zip_with("top_tfs", "top_lengths", lambda tf, length: self._ratio(state, tf, length)))

    def _part(self, weights: dict[str, float], ratio: Column) -> Column:
        """A word's share of a score, by tf / norm."""
        idf = F.lit(0.0)
        for t in sorted(weights):
            idf = F.when(F.col("term") == t, F.lit(weights[t])).otherwise(idf)
        return idf * (self.k1 + 1) * ratio / (ratio + self.k1)

    def _sums(self, blocks: DataFrame, state: State, weights: dict[str, float]) -> DataFrame:
        """``id, score`` over the postings of these blocks."""
        each = blocks.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        each = each.select("segment", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        live = self._live(each, state, state.segments)
        return live.withColumn("part", self._part(weights, self._ratio(state, F.col("tf"), F.col("length")))).groupBy("id").agg(F.sum("part").alias("score"))

    def _reaching(self, blocks: DataFrame, state: State, weights: dict[str, float], best: dict[str, float], floor: float) -> DataFrame:
        """The blocks that can hold a posting of a document that reaches ``floor``."""
        coarse = exact = F.lit(False)
        # Today's mean makes a ratio higher than the segment's did by the ratio of the means at most.
        grown = max([1.0, *(state.mean * n / length for n, length in state.segments.values() if length)])
        for t, idf in weights.items():
            share = ((floor - sum(x for u, x in best.items() if u != t)) * (1 - 1e-9) - 1e-9) / (idf * (self.k1 + 1))
            if share >= 1:
                continue
            ratio = self.k1 * share / (1 - share) if share > 0 else 0.0
            # The first is for the scan, which knows terms and peaks in the files' statistics.
            coarse |= (F.col("term") == t) & (F.col("peak") >= ratio / grown * (1 - 1e-9))
            exact |= (F.col("term") == t) & (self._peak(state) >= ratio)
        return blocks.where(coarse).where(exact)

    def blocks_for(self, query: str, k: int = 10, state: State | None = None) -> tuple[DataFrame, State, dict[str, float]]:
        """The blocks that a search reads, the version and the words' weights."""
        state = state or self.state()
        asked = query_tokens(query, self.stopwords, self.ignore, self.stemming)
        df = self._counts(state, asked) if asked and state.segments else {}
        weights = {t: math.log((state.documents - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
        blocks = self._postings(state.segments).where(F.col("term").isin(list(weights)))
        if not weights:
            return blocks, state, weights
        bound = self._part(weights, self._peak(state))
        best = {r["term"]: r["m"] for r in blocks.groupBy("term").agg(F.max(bound).alias("m")).collect()}
        floor = 0.0
        first = None
        for t in weights:  # the first blocks of each word, enough for k documents of it alone
            some = blocks.where(F.col("term") == t).orderBy(F.desc(bound)).limit(1 + -(-2 * k // BLOCK))
            first = some if first is None else first.unionByName(some)
        top = self._sums(first, state, weights).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if top["n"] == k:
            floor = top["s"]
        return self._reaching(blocks, state, weights, best, floor), state, weights

    def top_k(self, query: str, k: int = 10, among: DataFrame | None = None) -> DataFrame:
        """``id, score``, best first, ties by id. With ``among``, only ids of its key column are ranked, by whole scores."""
        if among is not None:
            state = self.state()
            _, _, weights = self.blocks_for(query, k, state)
            scored = self._sums(self._postings(state.segments).where(F.col("term").isin(list(weights))), state, weights)
            scored = scored.join(among.select(F.col(self.key).cast(self.id_type).alias("id")), "id", "left_semi")
        else:
            scored = self._sums(*self.blocks_for(query, k))
        return scored.orderBy(F.desc("score"), "id").limit(k)
