"""Phrase collocations of each language, grown from their prefixes in order of what they can still reach.

A phrase that occurs a times and is cut into parts that occur l and r times scores a * a / (l * r); its
lowest-scoring cut counts. Since a is no more than l or r, a phrase of three words scores at most
f(w1 w2) / f(w1), by its prefix, and at most f(w2 w3) / f(w3), by its suffix, before any phrase of three
words has been counted. Best-first growth: words are counted; those that occur ``least`` times grow to pairs,
which are counted; of the pairs only those grow whose bound, or whose own score, reaches a level, and each round
lowers the level for the languages that aren't settled: they are, once ``most`` surviving phrases score at
the level or above. What hasn't grown by then scores below all of these, ties included. A pair survives by
its longer phrases, so all pairs that score at the level or above grow whatever their bound.

Which words and pairs grow is told to the workers by bitmaps of hashes of a fixed size, which Spark
aggregates; a hash that two share only lets more phrases be counted. Counts are exact, added up in
each task before they are shuffled, and by the words themselves, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bytewords import inside, parts, words_in
from lodestone.llm.common import discard, released, stored
from lodestone.llm.neardup import mixed

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD = inside(_BREAKS + b" \t")
_BREAK = ~inside(_BREAKS)
#: Bits of a bitmap of hashes: 8 MB.
BITS = 1 << 26
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class Grown:
    """Bitmaps of hashes, one for each kind of word or pair that is asked about."""

    def __init__(self, maps: dict[str, np.ndarray]) -> None:
        self.maps = maps

    def has(self, kind: str, h: np.ndarray) -> np.ndarray:
        own = self.maps[kind]
        at = h & np.uint64(8 * len(own) - 1)
        return own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang, 1)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a sequence and what follows it."""
    return mixed(a * _TIMES + b)


class _Sums:
    """Phrases of ``n`` words and how often they occur, of consecutive texts of one task, given out when there are many."""

    def __init__(self, n: int, grown: Grown | None, most: int = 500_000) -> None:
        self.n, self.grown, self.most = n, grown, most
        self.langs: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, pa.Array]] = []
        self.size = 0

    def add(self, lang: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
        w = words_in(text, _WORD)
        coded = lang.dictionary_encode()
        own = np.array([self.langs.setdefault(x, len(self.langs)) for x in coded.dictionary.to_pylist()], np.int64)
        of = own[coded.indices.to_numpy()][w.row]
        # Words of one piece have as many breaks before them, in one text.
        breaks = np.cumsum(_BREAK[w.data])[w.start] if len(w.start) else np.zeros(0, np.int64)
        n = len(w.row)
        ok = np.zeros(max(0, n - self.n + 1), bool)
        if len(ok):
            ok = (w.row[: len(ok)] == w.row[self.n - 1 :]) & (breaks[: len(ok)] == breaks[self.n - 1 :])
        self.held.append((of, w.words, ok))
        self.size += n
        if self.size >= self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        words = pa.chunked_array([h[1] for h in self.held]).dictionary_encode().unify_dictionaries()
        terms = words.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
        lang = np.concatenate([h[0] for h in self.held])
        ok = np.concatenate([np.append(h[2], np.zeros(len(h[0]) - len(h[2]), bool)) for h in self.held])
        self.held, self.size = [], 0
        at = np.flatnonzero(ok)
        kinds = len(terms) * len(self.langs)
        one = lang * len(terms) + code  # a word of a language
        if self.grown is not None:
            h = word_hashes(terms.cast(pa.binary()))
            h = np.concatenate([mixed(h + np.uint64(_lang_hash(x))) for x in self.langs])
            if self.n == 2:
                held = self.grown.has("word", h)
                at = at[held[one[at]] & held[one[at + 1]]]
            else:
                at = at[self._growing(h, one, at)]
        if self.n == 1:
            count = np.bincount(one, minlength=kinds)
            key = np.flatnonzero(count)
            columns, n = [key], count[key]
        else:
            key = one[at] * len(terms) + code[at + 1]
            if self.n == 3 and kinds * len(terms) ** 2 >= 1 << 62:  # pairs get numbers of their own
                pairs, key = np.unique(key, return_inverse=True)
            else:
                pairs = None
            if self.n == 3:
                key = key * len(terms) + code[at + 2]
            key, n = np.unique(key, return_counts=True)
            columns = []
            for _ in range(self.n - 1):
                columns.append(key % len(terms))
                key = key // len(terms)
                if pairs is not None and len(columns) == 1:
                    key = pairs[key]
            columns = [key, *reversed(columns)]
        first = columns[0]
        langs = pa.array(list(self.langs), pa.string()).take(pa.array(first // len(terms)))
        texts = [terms.take(pa.array(c)) for c in (first % len(terms), *columns[1:])]
        for a in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([x.slice(a, 100_000) for x in (langs, *texts, pa.array(n))], ["lang", *(f"w{i + 1}" for i in range(self.n)), "n"])
        released()

    def _growing(self, h: np.ndarray, one: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which places begin three words worth counting: both pairs occur often enough, and the bounds of both or the score of one reach the level."""
        g, first = self.grown, joined_hash(h[one[at]], h[one[at + 1]])
        second = joined_hash(h[one[at + 1]], h[one[at + 2]])
        out = g.has("pair", first) & g.has("pair", second)
        some = np.flatnonzero(out)
        first, second = first[some], second[some]
        out[some] = (g.has("prefix", first) & g.has("suffix", second)) | g.has("scored", first) | g.has("scored", second)
        return out


def _counter(n: int, shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(n, shared.value if shared is not None else None)
        for batch in batches:
            for at, text in parts(batch.column(1), 2 << 20):
                yield from sums.add(batch.column(0).slice(at, len(text)), text)
            released()
        yield from sums.out()

    return run


def _counts(docs: DataFrame, n: int, shared=None, least: int = 1) -> DataFrame:
    names = [f"w{i + 1}" for i in range(n)]
    found = docs.mapInArrow(_counter(n, shared), f"lang string, {', '.join(f'{w} string' for w in names)}, n bigint")
    return found.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _hasher(columns: int):
    """The hash of a word of a language, or of two, as the workers have them, as a place in the bitmap."""
    last = np.uint64(BITS - 1)

    @F.arrow_udf("bigint")
    def hashed(lang: pa.Array, *words: pa.Array) -> pa.Array:
        coded = lang.dictionary_encode()
        own = np.array([_lang_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
        h = [mixed(word_hashes(w.cast(pa.binary())) + own) for w in words]
        h = h[0] if columns == 1 else joined_hash(h[0], h[1])
        return pa.array((h & last).astype(np.int64))

    return hashed


def _bitmaps(rows: DataFrame, kinds: dict[str, Column]) -> dict[str, np.ndarray]:
    """A bitmap of the rows' ``at`` for each condition; their size doesn't depend on the rows."""
    flat = rows.select("at", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda k: k.isNotNull())).alias("kind"))
    # Buckets of bitmaps count from 1, places inside from 0.
    found = flat.groupBy("kind", F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    out = {k: np.zeros(BITS // 8, np.uint8) for k in kinds}
    for r in found.collect():
        start = (r["bucket"] - 1) * 4096
        out[r["kind"]][start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, most: int = 2000, share: int = 50, start: int | None = None
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases of two or three words.

    A-Z are folded; ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs cut pieces into words; phrases lie in
    a piece. ``a``, ``l``, ``r`` are how often the phrase and the parts of its lowest-scoring cut occur, overlaps included, the
    first such cut at ties; ``n`` counts the language's words; ``score`` is floor(1000000 * a * a / (l * r)), exact. Candidates occur
    ``least`` times; one that lies inside a longer candidate with ``share`` percent of its occurrences is dropped. Order is by
    score, then ``a``, both falling, then phrase by bytes. Null texts are empty, a null language is ``und``; repeated rows count
    each time; texts are read whole; a table without words gives no rows; other columns don't matter.

    ``start`` is how many pairs score at the first level or above, twice ``most`` if not given; each round takes four times as many.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = stored(_counts(docs, 1), "phrases-words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.where(F.col("n") >= least).select("lang", F.col("w1").alias("w"), F.col("n").alias("f"))
    one = _bitmaps(words.select(_hasher(1)("lang", "w").alias("at")), {"word": F.lit(True)})
    shared = spark.sparkContext.broadcast(Grown(one))
    pairs = _counts(docs, 2, shared, least).withColumnRenamed("n", "a")
    left, right = words.select("lang", F.col("w").alias("w1"), F.col("f").alias("l")), words.select("lang", F.col("w").alias("w2"), F.col("f").alias("r"))
    pairs = pairs.join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    pairs = pairs.withColumns({"score": _score("a", "l", "r"), "by_prefix": _score_bound("l"), "by_suffix": _score_bound("r"), "at": _hasher(2)("lang", "w1", "w2")})
    pairs = stored(pairs.select("lang", "w1", "w2", "a", "l", "r", "score", "by_prefix", "by_suffix", "at"), "phrases-pairs")
    shared.unpersist()

    open_, done, first = pairs, None, start or 2 * most
    while True:
        # The score of the pair at place ``first``, or zero, which lets all grow.
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        level = open_.select("lang", "score").withColumn("p", place).where(F.col("p") <= first).groupBy("lang").agg(F.max("p").alias("p"), F.min("score").alias("s"))
        level = stored(level.select("lang", F.when(F.col("p") < first, 0).otherwise(F.col("s")).alias("level")), "phrases-levels")
        found = stored(_survivors(docs, open_.join(level, "lang"), least, share), "phrases-found")
        settled = found.groupBy("lang").agg(F.count("*").alias("k")).where(F.col("k") >= most).select("lang")
        settled = stored(settled.union(level.where("level = 0").select("lang")).distinct(), "phrases-settled")
        ready = found.join(settled, "lang", "left_semi")
        done = ready if done is None else done.union(ready)
        open_ = open_.join(settled, "lang", "left_anti")
        if open_.isEmpty():
            break
        first *= 4
    best = done.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= most)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _score_bound(of: str) -> Column:
    """What no phrase that grows from a pair can exceed, by the word at its outer end."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(18,0))) div cast({of} as decimal(18,0))")


def _survivors(docs: DataFrame, pairs: DataFrame, least: int, share: int) -> DataFrame:
    """All phrases that score at their language's ``level`` or above and lie in no longer one that drops them."""
    level = F.col("level")
    kinds = {"pair": F.lit(True), "prefix": F.col("by_prefix") >= level, "suffix": F.col("by_suffix") >= level, "scored": F.col("score") >= level}
    shared = docs.sparkSession.sparkContext.broadcast(Grown(_bitmaps(pairs, kinds)))
    threes = stored(_counts(docs, 3, shared, least).withColumnRenamed("n", "a"), "phrases-threes")
    shared.unpersist()
    own = lambda *names: pairs.select("lang", *(F.col(x).alias(y) for x, y in zip(("w1", "w2", "a", "l", "r", "level"), names, strict=True)))
    # Cut after one word: f(w1), f(w2 w3); after two: f(w1 w2), f(w3).
    met = threes.join(own("w1", "w2", "l2", "l1", "_x", "level"), ["lang", "w1", "w2"]).join(own("w2", "w3", "r1", "_y", "r2", "_z"), ["lang", "w2", "w3"])
    met = met.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    cut = F.col("s1") <= F.col("s2")
    long = met.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(cut, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(cut, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"), "level",
    )
    inner = threes.select("lang", "w1", "w2", "a").union(threes.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    short = pairs.where(F.col("score") >= level).join(inner, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score", "level")
    out = long.where(F.col("score") >= level).union(short)
    return out.drop("level")
