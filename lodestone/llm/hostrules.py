"""Quality rules with a verdict for each host.

Rules are counted on every document. The share of a host's documents that fail is shrunk towards the
shares of all hosts by a beta prior fitted to them (method of moments). A host is rejected when its shrunk
share, less twice its standard deviation, is above three times the prior's mean, or above a half where
that is less: so it is judged against the other hosts, and one with few documents not by chance. A host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, let, replaced, stored

SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words stand in runs of ``window`` words that the text holds twice or more, the first included.

    Runs are compared by 64-bit hashes within one text. Only texts with an equal pair are looked at closer.
    """

    def covered(places: Column) -> Column:
        step = lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(window), places[k + 1] - p)).otherwise(F.lit(window))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = lambda s, k: ((k > 0) & (ordered[F.greatest(k - 1, F.lit(0))]["g"] == s["g"])) | (
            (k + 1 < F.size(ordered)) & (ordered[F.least(k + 1, F.size(ordered) - 1)]["g"] == s["g"])
        )
        return F.sort_array(F.transform(F.filter(ordered, same), lambda s: s["i"]))

    def count(runs: Column) -> Column:
        ordered = F.sort_array(F.transform(runs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        closer = let(let(ordered, places), covered)
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(closer)

    def runs(hashes: Column) -> Column:
        first = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))
        return F.transform(first, lambda h, i: F.xxhash64(h, *(hashes[i + k] for k in range(1, window))))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), runs), count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of COUNTS (bigint) over the whole text; a null text has no words."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = replaced(docs, *COUNTS).withColumns({"_words": F.regexp_extract_all(content, F.lit(WORD), F.lit(0)), "n_symbols": F.regexp_count(content, F.lit(SYMBOLS)).cast("bigint"), "n_dup_lines": dup.cast("bigint")})
    found = let(
        F.col("_words"),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("c"), repeated_words(w).cast("bigint").alias("r")),
    )
    rows = rows.withColumn("_found", found).drop("_words")
    return rows.withColumns({"n_words": F.col("_found.n"), "word_chars": F.col("_found.c"), "n_repeat_words": F.col("_found.r")}).drop("_found")


def base_failed(least_words: int = 10, most_repeated: int = 20) -> Column:
    """Too few words, or more than ``most_repeated`` percent of them repeated."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) that match mean and variance of the hosts' shares; with nothing to tell, (0.5, 0.5).

    ``hosts``: docs, failed. Sampling noise is taken off the variance. One row of sums reaches the driver.
    """
    share = F.col("failed") / F.col("docs")
    r = hosts.where(F.col("docs") > 0).agg(F.count("*").alias("n"), F.sum(share).alias("s"), F.sum(share * share).alias("q"), F.sum(1.0 / F.col("docs")).alias("i")).first()
    if not r["n"] or r["n"] < 2:
        return 0.5, 0.5
    mean = r["s"] / r["n"]
    variance = max(r["q"] / r["n"] - mean * mean - mean * (1 - mean) * r["i"] / r["n"], 0.0)
    if not 0 < mean < 1:
        return max(mean, 0.01), max(1 - mean, 0.01)
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1000.0) if variance > 1e-9 else 1000.0
    return round(mean * strength, 6), round((1 - mean) * strength, 6)


def verdicts(hosts: DataFrame, alpha: float, beta: float, *, times: float = 3.0, most_failed: float = 0.5, sure: float = 2.0) -> DataFrame:
    """Adds ``host_rate``, the shrunk share of failures, and ``host_kept`` to ``host, docs, failed``."""
    total = F.col("docs") + F.lit(alpha + beta)
    rate = (F.col("failed") + F.lit(alpha)) / total
    low = F.col("host_rate") - sure * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (total + 1))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", low <= F.lit(min(most_failed, times * alpha / (alpha + beta))))


def judge_hosts(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", times: float = 3.0, most_failed: float = 0.5, sure: float = 2.0,
    most_bytes: int = 64 << 20, **rules,
) -> DataFrame:
    """doc_id, host, the counts, ``base_failed``, ``host_rate`` (shrunk share of failures) and ``kept``.

    A document is kept if it fails no rule and its host isn't rejected (see ``verdicts``). Null hosts are one
    host. One row for each row of ``docs``; repeated rows each count; null and empty texts have no words and
    fail; empty tables give empty results; other columns don't matter. The counts of a row are written once
    and read for both the sums by host and the join. A hot host is summed before its rows meet. The verdicts,
    one row a host, are broadcast where their measured size is below ``most_bytes``, so that no host's rows
    meet in one task; beyond it the join deals both sides by host and eight numbers, so that a host's rows go
    to eight tasks.
    """
    rows = measure(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), F.col(text).alias("_text")), "_text").drop("_text")
    rows = stored(rows.withColumn("base_failed", base_failed(**rules)), "hostrules")
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")), "hosts")
    found = verdicts(hosts, *beta_prior(hosts), times=times, most_failed=most_failed, sure=sure).select("host", "host_rate", "host_kept")
    size = hosts.agg(F.sum(F.octet_length("host") + 32).alias("n")).first()["n"] or 0
    if size <= most_bytes:
        out = rows.join(F.broadcast(found), "host")
    else:
        salt = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(8))
        out = rows.withColumn("_salt", salt).join(found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")))), ["host", "_salt"])
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    return out.select("doc_id", F.when(F.col("host") != "", F.expr("substring(host, 2)")).alias("host"), *COUNTS, "base_failed", "host_rate", "kept")
