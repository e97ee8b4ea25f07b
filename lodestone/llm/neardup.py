"""Near-duplicate classes with DartMinHash signatures.

A text is the weighted set of its runs of ``shingle`` words, weighted by how often they occur.
Similarity is weighted Jaccard: the sum of smaller weights over the sum of larger ones, which is plain
Jaccard where no run repeats. An element of weight w owns the region [0, w) of an axis; darts fall on
each unit of it at ranks that a Poisson process seeded by element and unit fixes, so two sets that
share a region share its darts. Each dart goes to one coordinate of the signature, which keeps the
dart of lowest rank: two sets agree in a coordinate with a probability equal to their similarity.

Copies are joined into one node first, by a digest of their words. Nodes that agree in a whole band of
coordinates meet in a bucket. Each member is compared with one centre of its bucket, and what that
leaves in different components is compared further (see ``_apart``), so a bucket of alike texts costs
as many comparisons as it has members, and no link that a bucket shows is lost. All comparisons are
exact, on the whole sets. Classes are the connected components of links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import boxed, discard, released, stored, unboxed

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 48:
            self[word] = value
        return value


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _times(n: int, c: np.uint64) -> np.uint64:
    return np.uint64(n * int(c) & 0xFFFFFFFFFFFFFFFF)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def cells(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The units of the weighted set of word runs, as distinct 64-bit numbers in ascending order.

    The second occurrence of a run is another unit than the first. Fewer words than ``shingle`` are one run.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(shingle, n)
    g = h[: n - k + 1].copy()
    for i in range(1, k):
        g = g * _C + h[i : n - k + 1 + i]
    g = np.sort(mixed(g + np.uint64(k)))
    same = np.flatnonzero(g[1:] == g[:-1]) + 1
    if len(same):
        first = np.ones(len(g), bool)
        first[same] = False
        starts = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        again = (np.arange(len(g)) - starts).astype(np.uint64)
        g = np.sort(np.where(again > 0, mixed(g ^ (again * _B)), g))
    return g


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """DartMinHash signatures, one row of ``k`` 64-bit darts a set; zeros for an empty set."""
    out = np.zeros((len(sets), k), np.uint64)
    sizes = np.array([len(s) for s in sets])
    todo, darts = np.flatnonzero(sizes), k * (math.log(k) + 4)
    while len(todo):
        unit = np.concatenate([sets[i] for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes[todo])
        limit = (darts / sizes[todo])[doc]
        best = np.full(len(todo) * k, np.inf)
        found = []
        rank, n = np.zeros(len(unit)), 0
        while len(unit):
            x = mixed(unit + _times(n, _C) + np.uint64(1))
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank < limit
            unit, doc, rank, limit = unit[hit], doc[hit], rank[hit], limit[hit]
            dart = mixed((unit ^ _A) + _times(n, _B))
            at = doc * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, at, rank)
            found.append((at, rank, dart))
            n += 1
        at, rank, dart = (np.concatenate(c) for c in zip(*found, strict=True))
        first = rank == best[at]
        own = np.zeros(len(todo) * k, np.uint64)
        own[at[first]] = dart[first]
        whole = np.isfinite(best).reshape(len(todo), k).all(1)
        out[todo[whole]] = own.reshape(len(todo), k)[whole]
        todo, darts = todo[~whole], darts * 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit number for each run of ``rows`` coordinates; equal only for the same run of equal ones."""
    n, k = signature.shape
    part = signature.reshape(n, k // rows, rows)
    x = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) * _C, part.shape[:2])
    for i in range(rows):
        x = mixed(x * _A + part[:, :, i])
    return x.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sets of units; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def _signer(shingle: int, n_bands: int, rows: int):
    kind = pa.struct([("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
    def signed(text: pa.Array) -> pa.Array:
        digests, own, out, held = [], [], [], 0

        def flush() -> None:
            out.extend(b.tolist() if len(s) else [] for b, s in zip(bands(signatures(own, n_bands * rows), rows), own, strict=True))
            own.clear()

        for t in text:
            words = words_of(t.as_py() or "")
            digests.append(hashlib.md5(b" ".join(words)).digest())
            own.append(cells(words, shingle))
            held += len(own[-1])
            if held > 400_000:
                flush()
                held = 0
        if own:
            flush()
        released()
        return pa.array([{"digest": d, "bands": b} for d, b in zip(digests, out, strict=True)], kind)

    return signed


def _packer(shingle: int):
    @F.arrow_udf(T.BinaryType())
    def packed(text: pa.Array) -> pa.Array:
        return pa.array([cells(words_of(t.as_py() or ""), shingle).tobytes() for t in text], pa.binary())

    return packed


@F.arrow_udf(T.DoubleType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    read = lambda x: np.frombuffer(x.as_py(), np.uint64)
    return pa.array([similarity(read(x), read(y)) for x, y in zip(a, b, strict=True)], pa.float64())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` of the nodes in ``edges`` (``a``, ``b``, bigint): the least node that can be reached.

    Each round takes the least label among neighbours and then the label of the label, so the number of
    rounds grows with the logarithm of a component's width. Sums are taken before rows meet, nothing is
    gathered by component, and each round's labels are written, so a lost executor costs no earlier round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    held = labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), name)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        now = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        now = stored(now, name)
        up = now.select(F.col("node").alias("n2"), F.col("c").alias("c2"))
        after = stored(now.join(up, now["c"] == up["n2"]).select("node", "old", F.col("c2").alias("component")), name)
        discard(held, now)
        held, labels = after, after.select("node", "component")
        if after.where("old <> component").isEmpty():
            discard(both)
            return labels


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike, by exact comparison."""
    left, right = sets.select(F.col("node").alias("a"), F.col("units").alias("ua")), sets.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    return pairs.join(left, "a").join(right, "b").where(_similar("ua", "ub") >= least).select("a", "b")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _unpacked(units: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(u.as_py(), np.int64) for u in units], pa.list_(pa.int64()))


def _centres(buckets: DataFrame) -> DataFrame:
    """``bucket, node, centre`` of buckets with two members or more.

    A bucket's centre is its member with the most company over all its buckets: of texts that vary one
    text, the one that varies least, which is alike to the most others.
    """
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(buckets.join(counts, "bucket"), "buckets")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centres = members.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node"))["node"].alias("centre"))
    return stored(members.select("bucket", "node").join(centres, "bucket"), "buckets")


def _apart(buckets: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs in different components that may yet be alike and have not been compared, all bucket mates among them.

    Pairs inside one component are settled. In each bucket only the members outside its commonest component
    look for partners, so the commonest, however large, is on one side only. Two texts of n and n' units
    with a similarity of t share o = t / (1 + t) * (n + n') units or more. With the units of every text in
    order of how many texts have them, rarest first, the first unit that two share stands at places i and
    i' with min(n - i, n' - i') >= o, so texts meet only by a unit that stands far enough in front in both,
    for the sizes of partners that the bucket holds. Units that one text alone has come first and meet nothing.
    """
    share, step = least / (1 + least), 1.03
    klass = lambda n: F.floor(F.log(n) / float(np.log(step)))
    of = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    counts = of.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    of = stored(of.join(main.drop("parts"), "bucket"), "members")

    units = sets.join(of.select("node").distinct(), "node", "left_semi").select("node", F.explode(_unpacked(F.col("units"))).alias("unit"))
    shared = units.groupBy("unit").agg(F.count("*").alias("f")).where("f > 1")
    common = units.join(shared, "unit")
    total = sets.select("node", (F.octet_length("units") / 8).cast("bigint").alias("n"))
    known = common.groupBy("node").agg(F.count("*").alias("m")).join(total, "node").where(F.col("m") >= least * F.col("n"))
    known = stored(known, "sizes")
    ranked = common.join(known, "node").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("f", "unit")))
    ranked = ranked.select("node", "unit", "n", (F.col("n") - F.col("m") + F.col("r") - 1).alias("i")).where(F.col("i") <= (1 - least) * F.col("n") + 1)
    ranked = stored(ranked, "prefixes")

    of = of.join(known, "node").withColumn("klass", klass(F.col("n")))
    few = of.where("component <> main").select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    asked = few.join(of.select("bucket", "klass").distinct(), "bucket")
    size = F.pow(F.lit(step), F.col("klass"))  # of the smallest partner of the class
    asked = asked.where((size * step >= least * F.col("nx") - 1) & (size <= F.col("nx") / least + 1)).select("x", "cx", "nx", "klass").distinct()
    front = asked.join(ranked.select(F.col("node").alias("x"), "unit", F.col("i").alias("ix")), "x").where(F.col("ix") <= F.col("nx") - share * (F.col("nx") + size) + 1)
    many = ranked.join(of.select("node", "component").distinct(), "node").withColumn("klass", klass(F.col("n")))
    close = F.least(F.col("nx") - F.col("ix"), F.col("n") - F.col("i")) >= share * (F.col("nx") + F.col("n")) - 1e-6
    met = front.join(many, ["unit", "klass"]).where((F.col("cx") != F.col("component")) & close)
    pairs = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, least: float = 0.8, n_bands: int = 24, rows: int = 4
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, class_hash, kept.

    Texts with the same words (white space and case apart) are copies; classes join copies and texts whose
    similarity is ``least`` or more. Ids are of any type that has an order. ``class_id, class_hash`` are id and text hash of the first document of
    the class by (doc_id, text hash), null ids first; ``kept`` marks it. Rows alike in id and text are all
    marked alike. Null and empty texts, and texts of white space, are copies of each other. Other columns
    don't matter; an empty table has no classes.

    A pair of similarity s shares no band with a probability of (1 - s ** rows) ** n_bands: 3e-6 at 0.8.
    """
    raw = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("text_hash"), F.col(text).alias("t"))
    base = base.withColumn("s", _signer(shingle, n_bands, rows)(F.col("t"))).select("doc_id", "text_hash", "s.digest", "s.bands")
    base = stored(base, "signatures")
    nodes = base.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = _centres(buckets)
    pairs = buckets.where("centre <> node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("i"), F.col("rep.text_hash").alias("h"))
    held = docs.select(F.col(doc_id).alias("d"), raw.alias("th"), F.col(text).alias("t"))
    held = held.join(wanted, F.col("d").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    sets = held.select("node", _packer(shingle)(F.col("t")).alias("units")).groupBy("node").agg(F.first("units").alias("units"))
    sets = stored(sets, "sets")

    links = stored(_links(pairs, sets, least), "links")
    labels = components(links)
    more = stored(_links(stored(_apart(buckets.select("bucket", "node"), labels, pairs, sets, least), "pairs"), sets, least), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    discard(buckets, pairs, sets, links, more)

    named = nodes.join(labels, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    heads = named.groupBy("component").agg(F.min("rep").alias("head"))
    named = named.join(heads, "component").select("digest", "head")
    out = base.drop("bands").join(named, "digest")
    kept = F.struct("doc_id", "text_hash").eqNullSafe(F.col("head"))
    return out.select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), F.col("head.text_hash").alias("class_hash"), kept.alias("kept"))


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each class, and one row of those alike in id and text; all its columns."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **options).where("kept")
    found = stored(found.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.count("*").alias("_n")), "kept")
    rows = boxed(docs, d=F.col(doc_id), h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    out = rows.join(found.where("_n = 1"), same, "left_semi")
    if not found.where("_n > 1").isEmpty():
        out = out.unionByName(rows.join(found.where("_n > 1"), same, "left_semi").dropDuplicates(["d", "h"]))
    return unboxed(out, docs.columns)
