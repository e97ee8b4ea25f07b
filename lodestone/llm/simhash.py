"""SimHash near-duplicates, with candidates pruned on a ring of segments.

A fingerprint of 64 bits is the majority, bit by bit, of the hashes of a text's runs of words. Two
fingerprints link when ``most`` bits or fewer differ. The bits are cut into ``most + 1`` segments on a ring.
If ``most`` bits differ in all, then from some segment on each chain of l consecutive segments differs in at
most l * most / (most + 1) bits: by going round a ring of numbers whose mean is in budget, some start keeps
every prefix in budget. So the first segment of the chain is equal, its first two differ in one bit at most,
the first three in two.

The first two conditions are keys: the first segment whole and three quarters of the second, as one bit can
spoil one quarter only. Distinct fingerprints meet by such a key, 16 times each, are tested for the whole
chain and then for all bits. A bucket gives a spanning forest of its links, not its pairs. A bucket beyond
``crowd`` members isn't compared: its members are dealt anew by the bits that the key leaves free, cut into
``most + 1`` parts, one of which is equal in any link, and so on; with few free bits left a bucket can't
be large. Links are the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bytewords import SPACED, parts, spaced, words_in
from lodestone.llm.common import discard, released, replaced, stored
from lodestone.llm.neardup import components

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_ALL = (1 << 64) - 1


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of 64-bit hashes: the bits that over half of a group have; zero for none.

    Each byte of a number counts one bit, so eight bits are summed at once, for 255 numbers at most.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        for j in range(8):
            out[some] |= (2 * ones[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(text: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprints of texts; fewer words than ``shingle`` are one run, no words have fingerprint zero."""
    out = np.zeros(len(text), np.uint64)
    for at, some in parts(text, 2 << 20):
        w = words_in(some, SPACED)
        joined, start, stop = spaced(w)
        n = np.bincount(w.row, minlength=len(some))
        last = np.cumsum(n)[w.row] - 1  # of the word's text
        begins = np.arange(len(start))
        begins = begins[(begins + shingle - 1 <= last) | (begins == last - n[w.row] + 1)]
        ends = np.minimum(begins + shingle - 1, last[begins])
        hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
        h = np.fromiter((hashed(view[a:b], SEED) for a, b in zip(start[begins].tolist(), stop[ends].tolist(), strict=True)), np.uint64, len(begins))
        out[at : at + len(some)] = majority(h, np.bincount(w.row[begins], minlength=len(some)))
    return out


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a bigint of the same bits."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = pa.array(fingerprints(texts, shingle).view(np.int64))
        released()
        return found

    return of(text)


def _cut(bits: list[int], n: int) -> list[list[int]]:
    """``n`` runs of ``bits``, their sizes one apart at most."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def chain_masks(most: int) -> list[int]:
    """The bits of each key: a segment, and the next one without one of its quarters."""
    ring = _cut(list(range(64)), most + 1)
    if not most:
        return [_ALL]
    return [_mask(ring[i]) | _mask(set(ring[(i + 1) % (most + 1)]) - set(q)) for i in range(most + 1) for q in _cut(ring[(i + 1) % (most + 1)], 4)]


@lru_cache(100_000)
def finer_masks(mask: int, most: int) -> list[int]:
    """``mask`` with one of ``most + 1`` parts of its free bits each."""
    return [mask | _mask(p) for p in _cut([b for b in range(64) if not mask >> b & 1], most + 1) if p] or [mask]


def in_budget(x: np.ndarray, most: int) -> np.ndarray:
    """Whether differing bits ``x`` have a start on the ring from which each chain keeps its budget."""
    n = most + 1
    d = np.stack([np.bitwise_count(x & np.uint64(_mask(s))) for s in _cut(list(range(64)), n)]).astype(np.int64)
    found = np.zeros(len(x), bool)
    for i in range(n):
        held = np.cumsum(np.roll(d, -i, axis=0), axis=0) * n <= most * np.arange(1, n + 1)[:, None]
        found |= held.all(axis=0)
    return found


def linked(x: np.ndarray, most: int) -> np.ndarray:
    """Whether at most ``most`` bits are set: candidates by their chains first, then by all bits."""
    out = in_budget(x, most)
    out[out] = np.bitwise_count(x[out]) <= most
    return out


def _forest(fp: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all of ``fp`` that links join, one fewer than members a tree."""
    a, b, left = [], [], fp
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(left ^ one) <= most
            found = left[near]
            if len(found):
                a.append(np.full(len(found), one))
                b.append(found)
                todo.extend(found)
                left = left[~near]
    return a, b


def bucket_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``key``, sorted, with distinct ``fp`` inside each run."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.repeat(np.diff(edge), np.diff(edge))
    place = np.arange(len(key)) - np.repeat(edge[:-1], np.diff(edge))
    a, b = [], []
    for step in range(1, 8):
        i = np.flatnonzero((size <= 8) & (place + step < size))
        if not len(i):
            break
        i = i[linked(fp[i] ^ fp[i + step], most)]
        a.append(fp[i])
        b.append(fp[i + step])
    for s in np.flatnonzero(np.diff(edge) > 8):
        more = _forest(fp[edge[s] : edge[s + 1]], most)
        a += more[0]
        b += more[1]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _compared(most: int, crowd: int):
    """Sorted rows (mask, fp) to links (a, b), or, of crowded buckets, to rows (mask, fp) of finer buckets, told by ``finer``."""
    schema = pa.schema([("finer", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])

    def rows(finer: bool, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), finer)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def dealt(mask: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for m in np.unique(mask):
            own = fp[mask == m]
            for f in finer_masks(int(m), most):
                yield from rows(True, np.full(len(own), f, np.uint64), own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        over: tuple[int, int] | None = None  # the crowded bucket that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)]
            mask, fp = np.concatenate((mask, own[0])), np.concatenate((fp, own[1]))
            part = fp & mask
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
            first = np.concatenate(([True], new[1:] | (fp[1:] != fp[:-1])))
            mask, fp, part, new = mask[first], fp[first], part[first], new[first]
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, len(fp)))
            many = size > crowd
            if over is not None and (int(mask[0]), int(part[0])) == over:
                many[0] = True
            over = (int(mask[-1]), int(part[-1])) if many[-1] else None
            crowded = np.repeat(many, size)
            if crowded.any():
                yield from dealt(mask[crowded], fp[crowded])
            ready = ~crowded
            tail = np.zeros(0, bool)
            if not many[-1]:  # the last bucket may go on
                tail = np.arange(len(fp)) >= edge[-1]
                ready &= ~tail
            if ready.any():
                yield from rows(False, *bucket_links(np.cumsum(new)[ready], fp[ready], most))
            mask, fp = (mask[tail], fp[tail]) if len(tail) else (mask[:0], fp[:0])
        if len(fp):
            yield from rows(False, *bucket_links(np.zeros(len(fp), np.int64), fp, most))

    return run


def fingerprint_links(prints: DataFrame, most: int = 3, crowd: int = 4096) -> DataFrame:
    """``a, b`` (bigint): links that connect the distinct fingerprints ``fp`` as all pairs within ``most`` bits do."""
    if not 0 <= most <= 12 or crowd < 1 << 12:
        raise ValueError("0 to 12 bits, and buckets of 4096 or more")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = prints.select(F.explode(F.array(*(F.lit(signed(m)).cast("bigint") for m in chain_masks(most)))).alias("mask"), "fp")
    links = None
    while True:
        part = F.col("fp").bitwiseAND(F.col("mask"))
        met = rows.repartition("mask", part).sortWithinPartitions("mask", part, "fp").mapInArrow(_compared(most, crowd), "finer boolean, a bigint, b bigint")
        met = stored(met, "simhash-links")
        found = met.where("not finer").select("a", "b")
        links = found if links is None else links.union(found)
        finer = met.where("finer")
        if finer.isEmpty():
            return links
        rows = finer.select(F.col("a").alias("mask"), F.col("b").alias("fp"))


def simhash_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, most: int = 3, crowd: int = 4096) -> DataFrame:
    """``docs`` without ``text``, with ``fp`` (bigint, the fingerprint's bits) and ``component_id``.

    ``component_id`` is the least ``doc_id`` that links reach, itself included; null ids count only where a
    component has no other. Columns of these two names are replaced, others stay. Null and empty texts and texts of white space have
    fingerprint zero and link like any other; rows alike in id or text each have their own row; texts are read whole,
    whatever their length; an empty table gives an empty table.
    """
    kept = replaced(docs, "fp", "component_id")
    own = [c for c in kept.columns if c.lower() != text.lower()]
    rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), fingerprint(F.col(text), shingle).alias("fp")), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min(F.col("row")[doc_id]).alias("least")), "simhash-prints")
    labels = components(fingerprint_links(prints.select("fp"), most, crowd), "simhash")
    named = stored(prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-named")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(named.select("fp", "component").join(heads, "component").select(F.col("fp").alias("f"), "component_id"), "simhash-heads")
    discard(prints, labels, named)
    out = rows.join(of, rows["fp"] == of["f"])
    return out.select(*(F.col("row")[c].alias(c) for c in own), "fp", "component_id")
