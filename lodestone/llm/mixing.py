"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / w``: u is a hash of its id in (0, 1), w its quality
weight, a column of the caller's or else one made of the text. Within a source documents are taken in ascending order of keys, so better ones tend to come
first, until their sizes reach the source's budget. Whole epochs come first: a budget of 1.4 times a
source is every document once and then 0.4 of the source by keys.

The running sums are taken in two steps, so that no source has to fit one task: keys fall into bins on
a logarithmic grid that grows finer with the square root of the table; sums over bins give where each
bin starts, and sums within bins do the rest. The bins decide only how the work is dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, boxed, stored, unboxed

SYMBOLS = r"[#*$%&|<>!]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for text without symbols, less as there are more of them for each word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return (1.0 + size) / (1.0 + size + 4.0 * symbols)


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number inside (0, 1) from 52 bits of the md5 of the id as text and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: ``share`` of all sizes dealt out by weight.

    Sources in code point order, null last, have the weights in turn. A target stops at ``most`` times
    its source; what is over goes to the others by weight. So a target is min(most * size, level * weight)
    for one level, found by sorting sources by where they stop. One row a source goes through one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("_stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_stop", F.lit(most) * F.col("source_size") / F.col("_w"))
    free_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("_level", left / free_weight)
    # The level that holds is that of the first source which it doesn't fill; past it nothing stops.
    level = F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", F.col("source").isNull(), "source", "_level"))).over(everything)["_level"]
    full = F.lit(most) * F.col("source_size")
    return rows.withColumn("target", F.coalesce(F.least(full, level * F.col("_w")), full)).drop("_w", "_stop", "_level")


def mix(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 0, weight: str | None = None,
) -> DataFrame:
    """How often the mix takes each document: doc_id, row_hash, size, source_size, target, copies, taken.

    One row for each row of ``docs``; ``row_hash`` is of all its columns. Sizes are words; null and empty
    texts have none and are taken with their epochs, at no cost. The document that crosses the end of a
    budget is taken if more than half of it fits. Ties of keys go by id, size and row; rows alike in all
    columns are interchangeable. Null sources are a source of their own. Of an empty table the result is
    empty. ``weight`` names a column of quality weights, such as a classifier's score; null, zero and negative
    ones count as 1e-9, so those documents come last. Without it the weight is that of ``quality_weight``.
    """
    size = word_count(F.col(text))
    given = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-9)) if weight else quality_weight(F.col(text), size)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_hash"),
        size.alias("size"), given.alias("w"),
    )
    rows = stored(rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("w")).drop("w"), "mix")
    fine = max(64.0, float(rows.count()) ** 0.5)
    rows = rows.withColumn("bin", F.floor(F.log(F.col("key")) * fine)).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    bins = rows.groupBy("s", "bin").agg(F.first("source").alias("source"), F.sum("size").alias("bin_size"))
    sizes = bins.groupBy("s").agg(F.first("source").alias("source"), F.sum("bin_size").alias("source_size"))
    goals = targets(sizes, weights=weights, share=share, most=most).drop("source")
    earlier = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("s", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("before")).join(goals, "s")
    inside = Window.partitionBy("s", "bin").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bins, ["s", "bin"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    rest = F.col("target") - epochs * F.col("source_size")
    partly = (rest > 0) & (F.col("before") + F.col("inside") + F.col("size") / 2.0 <= rest)
    rows = rows.withColumn("copies", epochs + partly.cast("int"))
    return rows.select("doc_id", "row_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns as they are."""
    plan = mix(docs, doc_id=doc_id, **options).groupBy(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"))
    plan = stored(plan.agg(F.sum("copies").cast("int").alias("_times"), F.count("*").alias("_n")).where("_times > 0"), "mix")
    rows = boxed(docs, id=F.col(doc_id), hash=F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    same = F.col("id").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_h"))
    taken = rows.join(plan.where("_n = 1"), same)
    if not plan.where("_n > 1").isEmpty():
        taken = taken.union(rows.join(plan.where("_n > 1"), same).dropDuplicates(["id", "hash"]))
    return unboxed(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs.columns)
