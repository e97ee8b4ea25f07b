"""Ranked lexical search over bit-sliced Bloom signatures.

``build`` reads the documents once. Documents of like numbers of terms share a block; a block is a matrix
of bits with a slice (a row) per hash value and a column per document, so one term's slices, combined
by AND, tell for all its documents at once which may hold the term. A term goes in once for each level of
its count in the document that it reaches (1, 2, 3, 4, 6, ...), so slices also bound how often it occurs. A set bit may be
another term's: slices overestimate, they never miss a term. Beside the blocks the index keeps how many
documents hold each term.

``top_k`` takes the items' terms, adds up weighted slices for each level and so has an upper bound of every
document's score. The documents with the highest bounds are scored exactly; the k-th of these scores is a
floor that the item's k-th best can't be below. All documents whose bound reaches the floor are scored
exactly from their texts, so the ranking is exact whatever the signatures say.

What reaches workers from the driver are items: they go in blocks of ``block_bytes`` of text. Of the
documents only keys and bounds move; texts meet their keys by a broadcast below a measured size, by a
shuffle beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bytewords import TERMS, parts, words_in
from lodestone.llm.common import discard, released, stored
from lodestone.llm.neardup import mixed

#: A term that occurs as often as a level says is in the slices of that level.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 24, 48)
HASHES = 4
BITS_A_KEY = 12
BLOCK_BITS = 1 << 22
SCALE = 1_000_000_000
_STEP = 0x9E3779B97F4A7C15
_FOUND = pa.schema(
    [("n_slices", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("term", pa.string()), ("df", pa.int64())]
)
_DDL = "n_slices bigint, keys array<bigint>, sizes array<bigint>, slices binary, term string, df bigint"


@dataclass(frozen=True)
class Index:
    """``blocks`` (n_slices, keys, sizes, slices), ``terms`` (term, df), documents with a term, and all their terms."""

    blocks: DataFrame
    terms: DataFrame
    documents: int
    length: int


def slices_of(h: np.ndarray, level: int, n_slices: int | np.ndarray) -> np.ndarray:
    """The slices of terms with hashes ``h`` at a level, ``HASHES`` a term; ``n_slices`` are powers of two."""
    x = mixed(h + np.uint64(level * _STEP & 0xFFFFFFFFFFFFFFFF))
    step = mixed(x) | np.uint64(1)
    most = np.asarray(n_slices - 1, np.uint64)
    return np.stack([(x + np.uint64(j) * step) & most for j in range(HASHES)], axis=1).astype(np.int64)


def hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))


def counted(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, and (text, term, occurrences) in order of texts."""
    w = words_in(text, TERMS)
    coded = w.words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(w.row * n + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, pair // n, pair % n, tf


class _Pending:
    """Documents of one number of slices that wait for their block to be full."""

    def __init__(self, n_slices: int) -> None:
        self.n_slices, self.most = n_slices, max(8, BLOCK_BITS // n_slices)
        self.keys: list[int] = []
        self.sizes: list[int] = []
        self.at: list[np.ndarray] = []

    def block(self) -> dict:
        wide = -(-len(self.keys) // 8) * 8
        bits = np.zeros((self.n_slices, wide), bool)
        for d, at in enumerate(self.at):
            bits[at, d] = True
        out = {"n_slices": self.n_slices, "keys": self.keys, "sizes": self.sizes, "slices": np.packbits(bits, axis=1).tobytes()}
        self.keys, self.sizes, self.at = [], [], []
        return out


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, _Pending] = {}
    blank = dict.fromkeys(_FOUND.names)
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for first, text in parts(batch.column(1), 2 << 20):
            terms, row, term, tf = counted(text)
            held = np.bincount(term, minlength=len(terms))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(terms), _FOUND.field(i).type) for i in range(4)), terms.cast(pa.string()), pa.array(held)], schema=_FOUND)
            h = hashes(terms.cast(pa.binary()))
            reached = [np.flatnonzero(tf >= level) for level in LEVELS]
            inserted = sum(np.bincount(row[r], minlength=len(text)) for r in reached)
            n_slices = np.array([1 << max(6, (BITS_A_KEY * int(n) - 1).bit_length()) for n in inserted])
            at = np.concatenate([slices_of(h[term[r]], level, n_slices[row[r]]) for level, r in zip(LEVELS, reached, strict=True)]).astype(np.int32)
            of = np.concatenate([row[r] for r in reached])
            at = at[np.argsort(of, kind="stable")]
            size = np.bincount(row, weights=tf, minlength=len(text)).astype(np.int64)
            edge = np.concatenate(([0], np.cumsum(inserted)))
            for d in np.flatnonzero(inserted):
                one = waiting.setdefault(int(n_slices[d]), _Pending(int(n_slices[d])))
                one.keys.append(int(keys[first + d]))
                one.sizes.append(int(size[d]))
                one.at.append(at[edge[d] : edge[d + 1]].ravel())
                if len(one.keys) == one.most:
                    yield pa.RecordBatch.from_pylist([blank | one.block()], _FOUND)
        released()
    for one in waiting.values():
        if one.keys:
            yield pa.RecordBatch.from_pylist([blank | one.block()], _FOUND)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text and a key of both; a key that two documents share only lets both be scored."""
    return docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))


def build(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> Index:
    """The index of all documents, written to the shared folder. Null texts and texts without terms are in no block."""
    found = stored(_keyed(docs, text, doc_id).select("key", "text").mapInArrow(_indexed, _DDL), "bitsliced")
    blocks = found.where("slices is not null").select("n_slices", "keys", "sizes", "slices")
    terms = stored(found.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "bitsliced-terms")
    total = found.where("slices is not null").agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("l")).first()
    return Index(blocks, terms, total["n"] or 0, total["l"] or 0)


@dataclass(frozen=True)
class Asked:
    """A block of items: their terms that documents hold, weights, and for each item (terms, weight times repeats)."""

    terms: dict[bytes, int]
    weight: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    documents: int
    length: int

    def slack(self, n: int) -> int:
        """m, by the number of a document's terms."""
        return 25 + (75 * int(n) * self.documents) // self.length


def asked(texts: list[list[str]], df: dict[bytes, int], documents: int, length: int) -> Asked:
    """For items given as lists of texts."""
    held = [t for t in sorted(df) if df[t] > 0]
    of = {t: i for i, t in enumerate(held)}
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in held], np.int64)
    items = []
    for one in texts:
        found = [of[t] for t in words_in(pa.array(one, pa.string()), TERMS).words.cast(pa.binary()).to_pylist() if t in of]
        term, n = np.unique(np.array(found, np.int64), return_counts=True)
        items.append((term, weight[term] * n))
    return Asked(of, weight, items, documents, length)


def bounds(q: Asked, h: np.ndarray, n_slices: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, items by documents of one block."""
    n = len(sizes)
    bits = np.frombuffer(slices, np.uint8).reshape(n_slices, -1)
    slack = 8 * np.array([q.slack(s) for s in sizes.tolist()], np.int64)
    out, before = np.zeros((len(q.items), n), np.int64), np.zeros(n, np.int64)
    present: np.ndarray | None = None
    for i, level in enumerate(LEVELS):
        at = slices_of(h, level, n_slices)
        here = bits[at[:, 0]]
        for j in range(1, HASHES):
            here &= bits[at[:, j]]
        if present is not None:
            here &= present
        present = here
        some = present.any(axis=1)
        if not some.any():
            break
        # A term that reaches this level and not the next occurs once less than the next level says, at most.
        most = np.minimum(LEVELS[i + 1] - 1, sizes) if i + 1 < len(LEVELS) else sizes
        worth = (SCALE * most) // (1000 * most + slack)
        gain, before = worth - before, worth
        for k, (term, weight) in enumerate(q.items):
            reach = some[term]
            if reach.any():
                ones = np.unpackbits(present[term[reach]], axis=1, count=n)
                out[k] += (weight[reach].astype(np.float64) @ ones).astype(np.int64) * gain
    return out


def _bounded(batches: Iterable[pa.RecordBatch], q: Asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, bounds) of each block."""
    h = hashes(pa.array(list(q.terms), pa.binary()))
    for batch in batches:
        for i in range(batch.num_rows):
            n_slices, keys, sizes, slices = (batch.column(c)[i] for c in range(4))
            yield keys.values.to_numpy(), bounds(q, h, n_slices.as_py(), sizes.values.to_numpy(), slices.as_buffer())


def _rows(item: np.ndarray, key: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(key), pa.array(bound)], ["item", "key", "bound"])


def _highest(shared, k: int):
    """Each task's ``k`` highest bounds of each item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Asked = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.items)
        for keys, bound in _bounded(batches, q):
            for i in range(len(q.items)):
                top = np.flatnonzero(bound[i] > 0)
                if len(top) > k:
                    top = top[np.argpartition(-bound[i][top], k - 1)[:k]]
                both = np.concatenate((best[i][0], keys[top])), np.concatenate((best[i][1], bound[i][top]))
                order = np.lexsort((both[0], -both[1]))[:k]
                best[i] = both[0][order], both[1][order]
        for i, (key, bound) in enumerate(best):
            if len(key):
                yield _rows(np.full(len(key), i), key, bound)

    return run


def _reaching(shared, floors: np.ndarray):
    """All (item, key) whose bound reaches the item's floor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bound in _bounded(batches, shared.value):
            item, d = np.nonzero(bound >= floors[:, None])
            if len(item):
                yield _rows(item, keys[d], bound[item, d])

    return run


def exact(q: Asked, text: pa.Array, wanted: list[list[int]]) -> list[list[tuple[int, int]]]:
    """For each text (item, score) of the items wanted of it, those above zero."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(text))]
    for first, some in parts(text, 2 << 20):
        terms, row, term, tf = counted(some)
        own = np.array([q.terms.get(t, -1) for t in terms.cast(pa.binary()).to_pylist()], np.int64)
        edge = np.searchsorted(row, np.arange(len(some) + 1))
        for d in np.flatnonzero(np.diff(edge)):
            n = tf[edge[d] : edge[d + 1]]
            of = own[term[edge[d] : edge[d + 1]]]
            slack, n = 8 * q.slack(int(n.sum())), n[of >= 0]
            worth = np.zeros(len(q.weight), np.int64)
            worth[of[of >= 0]] = (SCALE * n) // (1000 * n + slack)
            for item in wanted[first + d]:
                score = int((q.items[item][1] * worth[q.items[item][0]]).sum())
                if score > 0:
                    out[first + d].append((item, score))
    return out


def _scorer(shared):
    kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())]))

    @F.arrow_udf("array<struct<item:int,score:bigint>>")
    def scored(text: pa.Array, items: pa.Array) -> pa.Array:
        found = exact(shared.value, text, items.to_pylist())
        released()
        return pa.array([[{"item": i, "score": s} for i, s in one] for one in found], kind)

    return scored


def _scores(docs: DataFrame, pairs: DataFrame, shared, most_bytes: int) -> DataFrame:
    """``doc_id, item, score`` of (item, key) pairs, from the whole texts."""
    wanted = stored(pairs.groupBy("key").agg(F.collect_set("item").alias("items")), "bitsliced-wanted")  # no more items than a block has
    size = wanted.agg(F.sum(16 + 4 * F.size("items")).alias("n")).first()["n"] or 0
    met = docs.join(F.broadcast(wanted) if size <= most_bytes else wanted, "key")
    return met.select("doc_id", F.explode(_scorer(shared)("text", "items")).alias("s")).select("doc_id", "s.item", "s.score")


def top_k(
    docs: DataFrame, index: Index, items: DataFrame, k: int = 10, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = 256 << 10, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above zero, equal ones by id, null ids first.

    ``docs`` are those that the index was built of. Rows of one item id, null among them, are one item with all their terms.
    Null and empty texts have no terms: such items have no rows and such documents are never found. Documents alike in id and
    text each take a rank. Texts are scored whole, whatever their length. Empty tables give an empty one; other
    columns don't matter.
    """
    spark = docs.sparkSession
    kinds = {f.name.lower(): f.dataType.simpleString() for f in items.schema} | {"": ""}
    rows = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    keyed = _keyed(docs, text, doc_id)
    out = None
    blocks = max(1, -(-size // block_bytes)) if index.documents else 0
    for b in range(blocks):
        texts: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect():
            texts.setdefault(r["i"], []).append(r["t"])
        found = _ranked(spark, keyed, index, list(texts.values()), k, broadcast_bytes)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(texts)), f"item int, item_id {kinds[item_id.lower()]}")
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            found = stored(found, "bitsliced-ranked") if blocks > 1 else found
            out = found if out is None else out.union(found)
    if out is None:
        out = keyed.where("false").select(F.lit(None).cast(kinds[item_id.lower()]).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("bigint").alias("score"))
    return out


def _ranked(spark, keyed: DataFrame, index: Index, texts: list[list[str]], k: int, broadcast_bytes: int) -> DataFrame | None:
    """``item, rank, doc_id, score`` for one block of items; None where no document holds a term of them."""
    words = sorted({w for one in texts for w in words_in(pa.array(one, pa.string()), TERMS).words.to_pylist()})
    if not words:
        return None
    names = spark.createDataFrame([(w,) for w in words], "term string")
    df = {r["term"].encode(): r["df"] for r in index.terms.join(F.broadcast(names), "term").collect()}
    q = asked(texts, df, index.documents, index.length)
    if not df:
        return None
    shared = spark.sparkContext.broadcast(q)
    of = lambda run: index.blocks.mapInArrow(run, "item int, key bigint, bound bigint")
    highest = of(_highest(shared, 2 * k)).withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))).where(F.col("r") <= 2 * k)
    first = stored(_scores(keyed, highest.select("item", "key"), shared, broadcast_bytes), "bitsliced-first")
    floor = first.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= k)
    floors = np.ones(len(texts), np.int64)
    for r in floor.groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect():
        floors[r["item"]] = r["s"]
    pairs = stored(of(_reaching(shared, floors)).select("item", "key"), "bitsliced-pairs")
    scores = _scores(keyed, pairs, shared, broadcast_bytes)
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
    best = stored(best.select("item", "rank", "doc_id", "score"), "bitsliced-best")
    discard(first, pairs)
    return best
