"""Streams with state that ends: batches that settle, timers, and documents that come twice."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone import store
from lodestone.operators.chunking import RecursiveSplitter
from lodestone.streaming import jobs
from lodestone.types import PRESET

SCHEMA = "batch_id string, file_id string, status string, ts timestamp, n_files bigint"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def states(spark, path, rows):
    spark.createDataFrame([(b, f, s, at(m), n) for b, f, s, m, n in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows_in_state(query):
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])


def test_batches_settle_and_are_forgotten(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{x}" for x in ("src", "out", "log"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)

    def run():
        query = jobs.settle_batches(stream(), out, log, stale="10 minutes", late="1 minute")
        query.awaitTermination()
        found = {r["batch_id"]: (r["status"], r["total"], r["completed"], r["failed"], r["cancelled"], r["stale"]) for r in spark.read.schema(jobs.SETTLED).parquet(out).collect()}
        assert spark.read.schema(jobs.SETTLED).parquet(out).count() == len(found)  # each once
        return found, query

    states(spark, src, [("a", "1", "in_progress", 0, 2), ("a", "2", "completed", 1, 2), ("b", "1", "completed", 0, 1), ("c", "1", "completed", 1, 3), ("d", "1", "in_progress", 1, 1)])
    found, _ = run()
    assert found == {"b": ("completed", 1, 1, 0, 0, False)}
    # A newer state of a file counts, an older one that comes later doesn't; a settled batch isn't told again.
    states(spark, src, [("a", "1", "failed", 3, 2), ("b", "1", "completed", 3, 1)])
    states(spark, src, [("d", "1", "cancelled", 4, 1), ("d", "1", "in_progress", 3.5, 1)])
    found, _ = run()
    assert found["a"] == ("failed", 2, 1, 1, 0, False) and found["d"] == ("cancelled", 1, 0, 0, 1, False) and "c" not in found
    # Time goes on in another batch: c, of which two files never came, is given up.
    states(spark, src, [("e", "1", "in_progress", 30, 1)])
    found, query = run()
    assert found["c"] == ("failed", 3, 1, 2, 0, True) and len(found) == 4
    states(spark, src, [("e", "1", "completed", 60, 1)])
    states(spark, src, [("f", "1", "completed", 99, 1)])
    states(spark, src, [("c", "2", "completed", 1, 3)])  # older than the watermark
    found, query = run()
    assert set(found) == set("abcdef")
    states(spark, src, [("g", "1", "in_progress", 300, 1)])
    _, query = run()
    assert rows_in_state(query) == 1  # all but g's are gone


def test_documents_that_come_twice(spark, tmp_path):
    src, out, log = (f"{tmp_path}/{x}" for x in ("src", "out", "log"))
    write = lambda rows: spark.createDataFrame(rows, "id string, text string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    write([("a", "one two", at(0)), ("b", "three", at(1)), ("a", "one two", at(0))])
    write([("a", "one two", at(2)), ("c", "four", at(3))])
    for _ in range(2):
        jobs.ingest(spark, src, out, log, RecursiveSplitter(size=50), schema="id string, text string, ts timestamp", ts=F.col("ts"), late="10 minutes", files_a_batch=1).awaitTermination()
        write([("b", "three", at(4))])
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["four", "one two", "three"]


def test_file_tasks(spark, tmp_path):
    """Files are read, cut, added and summarised; errors and empty files fail; a replayed batch changes nothing."""
    src = f"{tmp_path}/src"
    rows = [("f1", "b", "in_progress", "word " * 400), ("f2", "b", "in_progress", None), ("f3", "b", "in_progress", "broken"), ("f4", "b", "completed", "other"), ("f5", "c", "in_progress", "short text")]
    spark.createDataFrame(rows, "file_id string, batch_id string, status string, content string").write.parquet(src)
    table = store.DocumentTable(spark, "file_task_chunks", PRESET, replace=True)

    def read(files):
        pages = files.select("file_id", F.explode_outer(F.array("content", F.substring("content", 1, 5))).alias("text"), F.when(F.col("content") == "broken", "can't be read").alias("error"))
        return pages.withColumn("page_no", F.lit(1) + F.length(F.coalesce("text", F.lit(""))))

    def run(log):
        stream = spark.readStream.schema("file_id string, batch_id string, status string, content string").parquet(src)
        jobs.run_file_tasks(stream, read, table, f"{tmp_path}/out", log, summarise=lambda t: F.substring(t, 1, 4), limit=20).awaitTermination()
        return {r["file_id"]: (r["batch_id"], r["status"], r["last_error"], r["n_chunks"], r["summary"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    found = run(f"{tmp_path}/log")
    assert {f: x[1:3] for f, x in found.items()} == {"f1": ("completed", None), "f2": ("failed", "no text"), "f3": ("failed", "can't be read"), "f5": ("completed", None)}
    assert found["f1"][3] > 2 and found["f1"][4] == "word" and found["f5"][4] == "shor" and found["f2"][3] == 0
    n = table.count()
    assert n == found["f1"][3] + found["f5"][3] and run(f"{tmp_path}/again") == found and table.count() == n
    table.drop()
