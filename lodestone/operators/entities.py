"""Rules over entity tables: runs, messages, files, batches.

Tables are DataFrames; each rule gives the rows after the change, for the caller to write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.aggregates import status_counts

FILE_STATUSES = ("in_progress", "completed", "cancelled", "failed")


def changed(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values where the condition holds; where it is null, nothing changes."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def patched(df: DataFrame, patches: DataFrame, *, key: str = "id") -> DataFrame:
    """Partial updates: the columns that a patch has and that aren't null in it replace the row's; a key has one patch at most."""
    given = [c for c in patches.columns if c != key and c in df.columns]
    new = patches.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_new_{c}") for c in given))
    out = df.join(new, df[key] == new["_k"], "left")
    return out.select(*(F.coalesce(F.col(f"_new_{c}"), df[c]).alias(c) if c in given else df[c] for c in df.columns))


def of_parent(df: DataFrame, parent: str, ident, *, status: Sequence[str] = (), order: str = "created_at", key: str = "id", newest: bool = True) -> DataFrame:
    """The messages, runs or steps of one thread or run, of some statuses only if any are named, in order of time and key."""
    rows = df.where(F.col(parent) == ident)
    rows = rows.where(F.col("status").isin(*status)) if status else rows
    return rows.orderBy(*((F.desc(order), F.desc(key)) if newest else (F.asc(order), F.asc(key))))


def can_delete(runs: DataFrame, threads: DataFrame) -> DataFrame:
    """Threads without a run that is in progress or being cancelled."""
    busy = runs.where(F.col("status").isin("in_progress", "cancelling")).select("thread_id").distinct()
    return threads.join(busy, threads["id"] == busy["thread_id"], "left_anti")


def without_threads(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a ``thread_id`` without the rows of deleted threads."""
    ids = gone.select(F.col("id").alias("thread_id")).distinct()
    return [t.join(ids, "thread_id", "left_anti").select(*t.columns) for t in tables]


def cancelled(files: DataFrame, condition: Column) -> DataFrame:
    """Files that were in progress become cancelled."""
    return changed(files, condition & (F.col("status") == "in_progress"), status=F.lit("cancelled"))


def batch_status(files: DataFrame, by: str = "batch_id") -> DataFrame:
    """Each batch's counts and status: cancelled before failed, in progress while any file is, else completed."""
    counts = status_counts(files, FILE_STATUSES, by=[by])
    status = (
        F.when(F.col("cancelled") > 0, "cancelled").when(F.col("failed") > 0, "failed").when(F.col("in_progress") > 0, "in_progress").otherwise("completed")
    )
    return counts.withColumn("status", status)


def pending(batches: DataFrame, n: int = 10) -> DataFrame:
    """The batches not yet looked at, longest unchanged first."""
    return batches.where(F.col("sanity_check_at").isNull()).orderBy("modified_at", "id").limit(n)


def expired(stores: DataFrame, now: Column) -> DataFrame:
    """Stores past their days since last use; 0 or null days never end."""
    return stores.where((F.col("days") > 0) & (F.timestamp_add("DAY", F.col("days"), F.col("last_active_at")) < now))


def mapped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns renamed to fields; columns without a field and fields without a column are passed over."""
    return df.select(*(F.col(f"`{c}`").alias(f) for c, f in fields.items() if c in df.columns))
