"""Change sets: inserts, partial updates and deletes of a table, in order of a version, applied in one pass.

A change is a row of the key, ``op`` ("insert", "update" or "delete"), ``version``, and columns of the table; nulls
of an update leave a column as it is. The changes of a key are first reduced to what they come to, with sums
in the tasks; then they meet the table once. Entity rules that touch several tables give a change set for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.snapshots import SnapshotTable

OPS = ("insert", "update", "delete")


def net(changes: DataFrame, *, key: str = "id") -> DataFrame:
    """One row a key: whether its row goes (``gone``), whether a new one is there (``born``), and the newest values that weren't null.

    What comes before the last delete of a key counts for nothing. Changes of one key and version are taken in order of op,
    deletes last.
    """
    columns = [c for c in changes.columns if c not in (key, "op", "version")]
    place = F.struct("version", F.array_position(F.array(*map(F.lit, ("insert", "update", "delete"))), F.col("op")).alias("o"))
    marked = changes.where(F.col("op").isin(*OPS)).withColumn("_at", place)
    last = marked.where("op = 'delete'").groupBy(key).agg(F.max("_at").alias("_gone"))
    rest = marked.where("op <> 'delete'")
    later = rest.join(last, key, "left").where(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    sums = later.groupBy(key).agg(
        F.max(F.col("op") == "insert").alias("born"), *(F.max(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).alias("v"))))["v"].alias(c) for c in columns)
    )
    out = sums.join(last, key, "full")
    return out.select(key, F.col("_gone").isNotNull().alias("gone"), F.coalesce("born", F.lit(False)).alias("born"), *columns)


def applied(rows: DataFrame, changes: DataFrame, *, key: str = "id") -> DataFrame:
    """The table after its changes: one join. Updates of rows that aren't there change nothing; an insert of one that is there updates it."""
    new = net(changes, key=key)
    given = [c for c in new.columns if c in rows.columns and c != key]
    right = new.select(F.col(key).alias("_k"), "gone", "born", *(F.col(c).alias(f"_new_{c}") for c in given))
    met = rows.withColumn("_there", F.lit(True)).join(right, F.col(key) == F.col("_k"), "full")
    gone, born = F.coalesce("gone", F.lit(False)), F.coalesce("born", F.lit(False))
    there = F.col("_there").isNotNull() & ~gone
    value = lambda c: F.coalesce(F.col(f"_new_{c}"), F.when(there, F.col(c))) if c in given else F.when(there, F.col(c))
    return met.where(there | born).select(*((F.coalesce(key, "_k") if c == key else value(c)).alias(c) for c in rows.columns))


def commit(table: SnapshotTable, changes: DataFrame, *, key: str = "id") -> int:
    """Applies changes to a table as one commit; gives its version. A commit meanwhile makes it fail, with no effect."""
    base = table.snapshot()
    added = table.write(applied(table.read(base.version), changes, key=key).select(*base.schema.fieldNames()))
    return table._commit(base, added, list(base.files), "changes", alone=True)


def cascade(parents: DataFrame, children: DataFrame, *, key: str = "id", child_key: str = "id", parent: str = "thread_id") -> DataFrame:
    """Deletes of the children of those rows that the parents' changes leave deleted."""
    gone = net(parents, key=key).where("gone and not born").select(F.col(key).alias(parent))
    return children.join(gone, parent, "left_semi").select(F.col(child_key), F.lit("delete").alias("op"), F.lit((1 << 63) - 1).cast("bigint").alias("version"))


def created_with_thread(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Changes of threads, messages and runs for requests (run_id, thread_id, assistant_id, version, messages of role and content), and those refused.

    A thread's messages begin with a user's and take turns; other requests are refused, with ``reason``.
    """
    turns = F.transform("messages", lambda m, i: F.when(i % 2 == 0, m["role"] == "user").otherwise(m["role"] == "assistant"))
    fits = (F.size("messages") > 0) & F.forall(turns, lambda x: F.coalesce(x, F.lit(False)))
    good, bad = requests.where(F.coalesce(fits, F.lit(False))), requests.where(~F.coalesce(fits, F.lit(False)))
    insert = F.lit("insert").alias("op")
    threads = good.select(F.col("thread_id").alias("id"), insert, "version")
    each = good.select("thread_id", "run_id", "version", F.posexplode("messages").alias("n", "m"))
    ident = F.concat_ws("/", "thread_id", F.col("n").cast("string"))
    messages = each.select(ident.alias("id"), insert, "version", "thread_id", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    runs = good.select(F.col("run_id").alias("id"), insert, "version", "thread_id", "assistant_id", F.lit("queued").alias("status"))
    return threads, messages, runs, bad.withColumn("reason", F.lit("messages of user and assistant have to take turns"))


def submitted(runs: DataFrame, required: DataFrame, outputs: DataFrame, version: Column) -> tuple[DataFrame, DataFrame]:
    """Changes of runs that wait for tool outputs (``requires_action``) and have got all of them, and what the others miss (run_id, tool_call_id)."""
    waiting = runs.where("status = 'requires_action'").select(F.col("id").alias("run_id"))
    asked = outputs.select("run_id").distinct().join(waiting, "run_id", "left_semi")
    missing = required.join(asked, "run_id", "left_semi").join(outputs.select("run_id", "tool_call_id").distinct(), ["run_id", "tool_call_id"], "left_anti")
    ready = asked.join(missing.select("run_id").distinct(), "run_id", "left_anti")
    return ready.select(F.col("run_id").alias("id"), F.lit("update").alias("op"), version.alias("version"), F.lit("queued").alias("status")), missing.select("run_id", "tool_call_id")


def cancelling(runs: DataFrame, which: Column, version: Column) -> DataFrame:
    """Changes of the runs that can still be cancelled: queued ones end, those in progress are told to."""
    hit = runs.where(F.coalesce(which, F.lit(False)) & F.col("status").isin("queued", "requires_action", "in_progress"))
    return hit.select("id", F.lit("update").alias("op"), version.alias("version"), F.when(F.col("status") == "in_progress", "cancelling").otherwise("cancelled").alias("status"))
