"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items are cut into windows of ``window`` words; the automaton holds each distinct window once and a
document is scanned once, whatever the number of items. Matches are found in the normalised text and
mapped to word numbers and to character offsets of the original.

The item texts are broadcast, and a worker's automaton takes some 370 bytes for each byte of them, as every word stands in many
windows. So their size is measured first: beyond ``block_bytes``, 1 MB, which is below 0.4 GB a worker, they are dealt
into blocks by hash and the documents, written once with numbers, are scanned once for each block; only
numbers and hits are carried on. Nothing about the documents is ever gathered.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import boxed, replaced, stored, unboxed

#: A word, after A-Z have become a-z, is a run of characters outside these ranges.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))
_BREAK = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
#: Byte to byte: letters to lower case, what is in no word to a space, bytes of other scripts as they are.
_NORMAL = bytes.maketrans(_LOWER[0] + _BREAK, _LOWER[1] + b" " * len(_BREAK))
_FOUND = "struct<n_words:bigint,hits:array<struct<first:bigint,last:bigint>>,items:array<string>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_automata: dict = {}


def normal_words(text: str) -> list[bytes]:
    """The words of a text, lower-cased in A-Z only, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(text: str, window: int) -> set[tuple[bytes, ...]]:
    """All runs of ``window`` words; the whole text when it has fewer words, nothing when it has none."""
    words = normal_words(text)
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def build(items: list[tuple[str, str]], window: int):
    """The automaton of all windows of ``(item id, text)``; None without any. A payload is (words, item ids)."""
    import ahocorasick

    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows(text or "", window):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), tuple(sorted(ids))))
    found.make_automaton()
    return found


def scan(text: str, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged intervals of hit word numbers (both ends included), ids of the items found."""
    words = normal_words(text)
    hits: list[tuple[int, int]] = []
    items: set[str] = set()
    if words and automaton is not None:
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        at = spaces = 0
        for end, (length, ids) in automaton.iter(line):
            spaces, at = spaces + line.count(" ", at, end), end
            hits.append((spaces - length, spaces - 1))
            items.update(ids)
    return len(words), merged(hits), items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals of whole numbers, adjacent ones joined, in order."""
    out: list[list[int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _scanner(items, key: str, window: int):
    """A vectorised function over texts; ``items`` is a broadcast, its automaton is built once in each worker."""

    @F.arrow_udf(_FOUND)
    def found(text: pa.Array) -> pa.Array:
        if key not in _automata:
            _automata.clear()
            _automata[key] = build(items.value, window)
        rows = [scan(t.as_py() or "", _automata[key]) for t in text]
        return pa.array(
            [{"n_words": n, "hits": [{"first": a, "last": b} for a, b in hits], "items": sorted(ids)} for n, hits, ids in rows],
            _ARROW,
        )

    return found


@F.arrow_udf(T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer")))
def _offsets(text: pa.Array, hits: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    out = []
    for t, spans in zip(text.to_pylist(), hits.to_pylist(), strict=True):
        if spans:
            lower = t.encode("utf-8", "surrogatepass").translate(bytes.maketrans(*_LOWER)).decode("utf-8", "surrogatepass")
            at = [m.span() for m in WORD.finditer(lower)]
            out.append([{"start": at[s["first"]][0], "stop": at[s["last"]][1]} for s in spans])
        else:
            out.append([])
    return pa.array(out, kind)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 1 << 20,
    offsets: bool = False,
) -> DataFrame:
    """Adds to each document what it shares with the benchmark items.

    New columns (columns of these names are replaced): ``n_words`` bigint; ``hits``, the merged
    intervals of word numbers inside occurrences of item windows; ``items``, the ids (as text, sorted)
    of the items with an occurring window; ``n_hit`` bigint, the words in ``hits``; with ``offsets``
    also ``spans``, the intervals as character offsets of the original text.

    Null and empty texts have no words and no hits; null item ids count as the id ``""``; items
    without words match nothing; repeated rows each get their own result; an empty table of items
    leaves every document clean. Texts are scanned whole.
    """
    spark = docs.sparkSession
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")
    )
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    kept = replaced(docs, "n_words", "hits", "items", "n_hit", "spans")
    out = boxed(docs, text=F.col(text))
    scanned = lambda part, df: df.withColumn("found", _scanner(spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()]), uuid.uuid4().hex, window)(F.col("text")))
    if blocks == 1:
        out = scanned(rows, out).select(*out.columns, "found.n_words", "found.hits", "found.items")
    else:
        # The texts are written once, with numbers; each block's pass gives hits by number.
        out = stored(out.withColumn("_n", F.monotonically_increasing_id()), "leaks-rows")
        found = None
        for b in range(blocks):
            one = scanned(rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b), out.select("_n", "text")).select("_n", "found.*")
            one = stored(one if b == 0 else one.where(F.size("hits") > 0), "leaks")  # the first has all documents' words
            found = one if found is None else found.unionByName(one)
        joined = found.groupBy("_n").agg(
            F.max("n_words").alias("n_words"), _union(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        out = out.join(joined, "_n").drop("_n")
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    added = {"n_words": F.col("n_words"), "hits": F.col("hits"), "items": F.col("items"), "n_hit": n_hit}
    if offsets:
        added["spans"] = _offsets(F.col("text"), F.col("hits"))
    return unboxed(out, kept.columns, **added)


def _union(hits: Column) -> Column:
    """Merges intervals that several blocks of items have found."""
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def step(done: Column, s: Column) -> Column:
        tail = F.element_at(done, -1)
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], s["last"]).alias("last"))
        return (
            F.when(F.size(done) == 0, F.array(s))
            .when(s["first"] <= tail["last"] + 1, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(s)))
        )

    return F.aggregate(F.array_sort(hits), empty, step)


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", most_hit: float = 0.0, **options) -> DataFrame:
    """The documents of which at most the share ``most_hit`` of words is hit, with their own columns only."""
    found = find_leaks(boxed(docs, text=F.col(text)), items, text="text", **options)
    return unboxed(found.where(F.col("n_hit") <= most_hit * F.col("n_words")), docs.columns)
