"""Line deduplication by fingerprints of lines and of runs of lines.

Lines with a word are hashed. A line that counts alone, with ``least_words`` words or ``long_line``
characters, is a fingerprint, and so are ``gram`` consecutive lines unless all of them count alone. Each
fingerprint is joined with the first place that holds it, documents in order of id; what stands earlier
is deleted, the first place stays. This is winnowing with a window of one: as single lines count, each is
the least of its window, and matches need no extension. A wider window would leave out repeated lines.

What is guaranteed: every line that counts alone and every run of ``gram`` lines or more that stands at
an earlier place of the given documents is deleted, and nothing else is. A line's first place is never
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, boxed, let, stored


def _numbered(text: Column) -> Column:
    """Lines with a word, as (number among all lines, hash, text)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    worded = F.filter(lines, lambda s: F.rlike(s["x"], F.lit(WORD)))
    return F.transform(worded, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), s["x"].alias("x")))


def _fingerprints(lines: Column, gram: int, least_words: int, long_line: int) -> Column:
    """(hash, numbers of its lines) of lines that count alone and of runs that hold another."""
    words = rf"(?:{WORD}[\x20\x09-\x0D]+){{{max(least_words, 1) - 1}}}{WORD}"
    marked = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), s["h"].alias("h"), (F.rlike(s["x"], F.lit(words)) | (F.length(s["x"]) >= long_line)).alias("l")))

    def found(marked: Column) -> Column:
        alone = F.transform(F.filter(marked, lambda s: s["l"]), lambda s: F.struct(F.xxhash64(s["h"], F.lit("line")).alias("f"), F.array(s["i"]).alias("at")))
        starts = F.slice(marked, F.lit(1), F.greatest(F.size(marked) - (gram - 1), F.lit(0)))
        runs = F.transform(starts, lambda _, i: F.slice(marked, i + 1, gram))
        runs = F.filter(runs, lambda r: F.exists(r, lambda s: ~s["l"]))
        return F.concat(alone, F.transform(runs, lambda r: F.struct(F.xxhash64(r["h"]).alias("f"), r["i"].alias("at"))))

    return let(marked, found)


def repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", gram: int = 2, least_words: int = 2, long_line: int = 200) -> DataFrame:
    """For each document with deletions: ``doc_id``, ``text_hash`` and ``gone``, the numbers (from 0) of its lines to delete.

    Rows alike in id and text are one document. Documents come in order of id, of any type that has an order,
    null first, then of the hash of their text. Lines are compared as they are; lines without a word are neither compared nor
    deleted, and don't interrupt a run.
    """
    key = [F.col(doc_id).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t")]
    prints = docs.select(*key, F.explode(_fingerprints(_numbered(F.col(text)), gram, least_words, long_line)).alias("f"))
    prints = stored(prints.select("d", "t", F.col("f.f").alias("f"), F.col("f.at").alias("at")), "prints")
    place = F.struct("d", "t", F.col("at")[0].alias("p"))
    first = prints.groupBy("f").agg(F.min(place).alias("e"), F.max(place).alias("z")).where("e <> z").drop("z")
    # Stored, so that both sides of the join are plain shuffles: a fingerprint that a third of the documents hold is split over tasks.
    met = prints.join(stored(first, "first"), "f").where(place > F.col("e"))
    gone = met.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("gone"))
    return gone.select(F.col("d").alias("doc_id"), F.col("t").alias("text_hash"), "gone")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with later repeated lines and runs of lines deleted from ``text``, and ``n_lines``, ``n_removed`` (bigint).

    Columns of those two names are replaced, others stay. Null and empty texts stay as they are, with one
    line if empty and none if null. Texts without deletions don't change by a character. An empty table gives
    an empty table. Of rows alike in id and text all lose the same lines; the time grows with a text's lines.
    """
    gone = stored(repeated_lines(docs, text=text, doc_id=doc_id, **options), "gone")
    rows = boxed(docs, d=F.col(doc_id), h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # Always by merging: whether the deletions would fit a broadcast must not change how the texts move.
    rows = rows.join(gone.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left")
    content, none = F.col("row")[text], F.col("gone").isNull()
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: lines[i])
    kept = F.array_join(let(F.split(content, "\n", -1), stay), "\n")
    counts = {
        "n_lines": F.coalesce(F.regexp_count(content, F.lit("\n")) + 1, F.lit(0)).cast("bigint"),
        "n_removed": F.when(none, F.lit(0)).otherwise(F.size("gone")).cast("bigint"),
    }
    own = [c for c in docs.columns if c.lower() not in counts]
    return rows.select(*(F.when(none, content).otherwise(kept).alias(c) if c.lower() == text.lower() else F.col("row")[c].alias(c) for c in own), *(c.alias(n) for n, c in counts.items()))
