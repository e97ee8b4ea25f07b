"""A vault of files: fetched once, kept with their checksums, and checked when asked.

Entries are rows of a ``SnapshotTable``, named by the digest of their content, so equal files are kept once
and each fetch is one commit. Contents are read, digested and compared where Spark reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.lineage import cut_lineage, discard
from lodestone.snapshots import SnapshotTable

_SCHEMA = T.StructType().add("name", "string").add("algorithm", "string").add("checksum", "string").add("metadata", T.MapType(T.StringType(), T.StringType())).add("length", "long").add("content", "binary")
_KEY = ["name", "algorithm", "checksum", "metadata"]
#: Adds ``content`` (binary, null where nothing was found) to resources.
Fetch = Callable[[DataFrame], DataFrame]


def digest_of(content: Column, algorithm: Column) -> Column:
    """md5, sha1 or sha256 as lower-case hex; null for other algorithms."""
    return F.when(algorithm == "md5", F.md5(content)).when(algorithm == "sha1", F.sha1(content)).when(algorithm == "sha256", F.sha2(content, 256))


def from_files(path: str = "path") -> Fetch:
    """Fetches by the resources' ``path``, any that Spark's file source reads."""

    def fetch(resources: DataFrame) -> DataFrame:
        spark = resources.sparkSession
        paths = [r[path] for r in resources.select(path).distinct().collect()]  # one name a file, as for any list of files
        if not paths:
            return resources.withColumn("content", F.lit(None).cast("binary"))
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths).select(F.col("path").alias("_p"), F.col("content"))
        bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
        return resources.join(files, bare(F.col(path)) == bare(F.col("_p")), "left").drop("_p")

    return fetch


class FileVault:
    """Files below ``path``, by name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, SnapshotTable(spark, path, _SCHEMA)

    def entries(self) -> DataFrame:
        """What is kept, without contents."""
        return self.table.read().drop("content")

    def _checked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("ok", F.coalesce(digest_of(F.col("content"), F.col("algorithm")) == F.lower("checksum"), F.lit(False)))

    def _fetched(self, resources: DataFrame, fetch: Fetch) -> DataFrame:
        """Contents that fit their checksums: what doesn't at first is fetched once more, and then is an error."""
        first = cut_lineage(self._checked(fetch(resources)), "vault")
        bad = first.where("not ok").select(*resources.columns)
        if bad.isEmpty():
            return first
        again = cut_lineage(self._checked(fetch(bad)), "vault")
        still = [r["name"] for r in again.where("not ok").select("name").limit(20).collect()]
        if still:
            discard(first, again)
            raise ValueError(f"checksums don't fit twice: {', '.join(still)}")
        return first.where("ok").unionByName(again)

    def get(self, resources: DataFrame, fetch: Fetch) -> DataFrame:
        """``name, content`` of resources (name, algorithm, checksum, metadata and what ``fetch`` needs); those not kept yet are fetched in one commit."""
        held = self.table.read().select("name", "algorithm", F.lower("checksum").alias("checksum")).distinct()
        new = resources.withColumn("checksum", F.lower("checksum")).join(held, ["name", "algorithm", "checksum"], "left_anti")
        new = cut_lineage(new.dropDuplicates(["name", "algorithm", "checksum"]), "vault-new")
        if not new.isEmpty():
            rows = self._fetched(new, fetch)
            self.table.append(rows.select(*_KEY, F.octet_length("content").cast("bigint").alias("length"), "content"))
        wanted = resources.select("name", "algorithm", F.lower("checksum").alias("checksum")).distinct()
        return self.table.read().join(wanted, ["name", "algorithm", "checksum"], "left_semi").select("name", "content")

    def verify(self) -> DataFrame:
        """Entries whose content no longer fits its checksum or length."""
        rows = self._checked(self.table.read())
        return rows.where(~F.col("ok") | (F.octet_length("content") != F.col("length"))).select(*_KEY)

    def repair(self, resources: DataFrame, fetch: Fetch) -> int:
        """Fetches damaged entries again, once and once more, and replaces them in one commit; gives their number."""
        damaged = cut_lineage(self.verify(), "vault-damaged")
        n = damaged.count()
        if n:
            sources = resources.withColumn("checksum", F.lower("checksum")).join(damaged.select("name", "algorithm", "checksum"), ["name", "algorithm", "checksum"], "left_semi")
            fresh = self._fetched(sources.dropDuplicates(["name", "algorithm", "checksum"]), fetch)
            fresh = fresh.select(*_KEY, F.octet_length("content").cast("bigint").alias("length"), "content")
            same = ["name", "algorithm", "checksum"]
            fixed = lambda df: df.join(fresh.select(*same), same, "left_anti").select(*_KEY, "length", "content").union(fresh)
            self.table.rewrite(lambda df: df.join(damaged.select(*same), same, "left_semi"), fixed, "repair")
        discard(damaged)
        return n

    def remove(self, name: str) -> int:
        own = F.col("name") == name
        return self.table.rewrite(lambda df: df.where(own), lambda df: df.where(~own), "delete")
