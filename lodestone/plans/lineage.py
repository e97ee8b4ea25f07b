"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` with its file system, that of the session where none is named.

    Where it is unset, a session on one machine, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, that of the session where none is named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


_owned: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses, in the application's own folder, which goes when the application ends."""
    own = f"{shared_folder(spark).rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_delete, at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _delete(fs, at) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        fs.delete(at, True)


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost no earlier step."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut_lineage`` wrote for these tables, once nothing is read from them any more; others stay as they are."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None) if "_lodestone_path" in vars(df) else None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: str | None, name: str) -> DataFrame:
    """``df`` with dense row numbers from 1, by ``order``, ties in no defined order, or without one as the rows come.

    Rows are dealt by ranges and sorted inside, so a number is the rows of earlier ranges and the place in its
    own; no task has all rows. One row a range reaches the driver.
    """
    dealt = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    rows = cut_lineage(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    first, before = {}, 0
    for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_place").alias("low")).collect(), key=lambda r: r["_part"]):
        first[r["_part"]] = before - r["low"]
        before += r["n"]
    shift = df.sparkSession.createDataFrame(list(first.items()), "_part int, _shift bigint")
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_place") + F.col("_shift") + 1).drop("_part", "_place", "_shift")


def running(df: DataFrame, order: Sequence[str], value: Column, *, number: str, total: str) -> DataFrame:
    """``df`` with dense row numbers from 1 by ``order`` and the sum of ``value`` up to each row, itself included.

    As ``numbered``: rows are dealt by ranges, sums run inside a range, and one row a range reaches the driver. Ties come in
    one order for both. The rows are written once.
    """
    dealt = df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "running")
    shifts, n, s = [], 0, 0
    for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_value").alias("s"), F.min("_place").alias("low")).collect(), key=lambda r: r["_part"]):
        shifts.append((r["_part"], n - r["low"] + 1, s))
        n, s = n + r["n"], s + (r["s"] or 0)
    shift = df.sparkSession.createDataFrame(shifts, "_part int, _n bigint, _s bigint")
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_inside", inside).join(F.broadcast(shift), "_part")
    return out.withColumns({number: F.col("_place") + F.col("_n"), total: F.col("_inside") + F.col("_s")}).drop("_part", "_place", "_value", "_inside", "_n", "_s")
