"""Structured Streaming jobs: continuous ingest, windowed counts, task handling, batch supervision."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lodestone.functions.text import is_blank
from lodestone.operators.chunking import RecursiveSplitter, Splitter, split_documents
from lodestone.operators.entities import FILE_STATUSES, batch_status
from lodestone.plans.chains import summaries
from lodestone.plans.lineage import cut_lineage, discard
from lodestone.store import DocumentTable, VectorTable

Handler = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, splitter: Splitter, *, schema: str | StructType, text: str = "text", key: str = "id", once: bool = True, ts: Column | None = None, late: str = "1 day", files_a_batch: int | None = None) -> StreamingQuery:
    """Reads Parquet files as they come, chunks them and writes the chunks; with ``ts``, the time of a document, each document once.

    A document that comes again within ``late`` of the newest is passed over, and so is what is older than that. Chunk ids are hashes of parent and number, and the file sink commits each batch once, so a restart
    from the checkpoint neither loses nor repeats a file.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    if ts is not None:
        rows = distinct(rows.withColumn("_ts", ts), [key], ts="_ts", late=late).drop("_ts")
    writer = split_documents(rows, splitter, text=text, key=key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; windows close ``late`` after the newest event."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def dispatched(tasks: DataFrame, handlers: Mapping[str, Handler], *, category: str = "category") -> DataFrame:
    """``task_id, category, outcome`` of a batch of tasks: every handler runs on the tasks of its category.

    A handler adds a boolean ``ok``. Outcomes are handled, failed (also where ``ok`` is null) and, of
    categories without a handler, unhandled.
    """
    out = tasks.where(~F.coalesce(F.col(category).isin(*handlers), F.lit(False))).select("task_id", category, F.lit("unhandled").alias("outcome"))
    for name, handler in handlers.items():
        done = handler(tasks.where(F.col(category) == name))
        out = out.unionByName(done.select("task_id", category, F.when(F.col("ok"), "handled").otherwise("failed").alias("outcome")))
    return out


def run_tasks(tasks: DataFrame, handlers: Mapping[str, Handler], out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Handles a stream of tasks; each micro-batch's outcomes replace its own folder, so a replay changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        dispatched(batch, handlers).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = tasks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def supervise(files: DataFrame, out: str, checkpoint: str, *, by: str = "batch_id", once: bool = True) -> StreamingQuery:
    """Keeps each batch's status up to date from a stream of file states (file_id, batch_id, status, ts)."""
    last = files.groupBy(by, "file_id").agg(F.max_by("status", "ts").alias("status"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_status(batch, by).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    writer = last.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


#: What ``settled`` gives of a batch: its files by status, and whether all had ended or the rest was given up.
SETTLED = "batch_id string, status string, total bigint, completed bigint, failed bigint, cancelled bigint, stale boolean, last_ts timestamp"
_STATE = "files array<string>, statuses array<string>, times array<bigint>, expected bigint, ended boolean"


def _settler(stale: int, keep: int):
    """For ``applyInPandasWithState``: the newest status of each file of a batch, until all have ended or nothing has come for ``stale`` ms."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files, statuses, times, expected, ended = state.get if state.exists else ([], [], [], 0, False)
        held = {f: (t, s) for f, s, t in zip(files, statuses, times, strict=True)}
        for frame in frames:
            for f, s, t, n in frame[["file_id", "status", "ms", "n_files"]].itertuples(index=False):
                held[f] = max(held.get(f, (t, s)), (t, s))
                expected = max(expected, int(n))
        late = state.hasTimedOut
        if ended:  # what comes behind the end only moves the time when that is forgotten
            if late:
                state.remove()
            return
        counts = {s: sum(x == s for _, x in held.values()) for s in FILE_STATUSES}
        done = sum(n for s, n in counts.items() if s != "in_progress") >= max(expected, len(held))
        last = max(t for t, _ in held.values())
        now = state.getCurrentWatermarkMs()
        if done or late:
            failed = counts["failed"] + (0 if done else max(expected, len(held)) - sum(n for s, n in counts.items() if s != "in_progress"))
            status = "cancelled" if counts["cancelled"] else "failed" if failed else "completed"
            yield pd.DataFrame([(key[0], status, max(expected, len(held)), counts["completed"], failed, counts["cancelled"], not done, pd.Timestamp(last, unit="ms"))], columns=[c.split()[0] for c in SETTLED.split(", ")])
            # Only the end is kept, until the watermark shuts out what may still come for the batch.
            state.update(([], [], [], expected, True))
            state.setTimeoutTimestamp(max(last + keep, now + 1))
        else:
            names = list(held)
            state.update((names, [held[f][1] for f in names], [held[f][0] for f in names], expected, False))
            state.setTimeoutTimestamp(max(last + stale, now + 1))

    return run


def settled(files: DataFrame, *, stale: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """A stream of batches that have settled, from a stream of file states (batch_id, file_id, status, ts, n_files).

    A batch settles when all its ``n_files`` files have ended, or when the watermark, ``late`` behind the newest ``ts``, has passed its
    newest state by ``stale``: files in progress or not yet seen then count as failed. Cancelled goes before failed. Each
    batch comes once. Its state holds one row a file until then, and goes when the watermark has passed its end.
    """
    rows = files.select(
        F.col("batch_id").cast("string").alias("batch_id"), F.col("file_id").cast("string").alias("file_id"), "status", F.col("n_files").cast("bigint").alias("n_files"), F.col("ts").cast("timestamp").alias("ts")
    )
    rows = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    stale_ms, late_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (stale, late))
    return rows.groupBy("batch_id").applyInPandasWithState(_settler(stale_ms, late_ms), SETTLED, _STATE, "append", "EventTimeTimeout")


def settle_batches(files: DataFrame, out: str, checkpoint: str, *, once: bool = True, **options) -> StreamingQuery:
    """Writes ``settled`` batches as they settle, each once, to Parquet."""
    writer = settled(files, **options).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def distinct(rows: DataFrame, keys: Sequence[str], *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key of a stream. Keys are remembered until the watermark, ``late`` behind the newest ``ts``, has passed them."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


Reader = Callable[[DataFrame], DataFrame]


def file_results(files: DataFrame, read: Reader, chunks: VectorTable | DocumentTable, *, splitter: Splitter | None = None, summarise: Callable[[Column], Column] | None = None, limit: int = 4000) -> DataFrame:
    """``file_id, batch_id, status, last_error, n_chunks, summary`` of a batch of files in progress.

    ``read`` turns files into rows (file_id, page_no, text, error), any number a file. A file with an error, or without a text, has
    failed; of the others the chunks, by default of 800 characters with 400 shared, are added to ``chunks`` in one commit, and a summary of the pages is made by a tree of summaries.
    """
    pages = cut_lineage(read(files.where("status = 'in_progress'")).select("file_id", "page_no", "text", "error"), "pages")
    errors = pages.groupBy("file_id").agg(F.min("error").alias("last_error"), F.count(F.when(~is_blank(F.col("text")), 1)).alias("n_pages"))
    good = pages.join(errors.where("last_error is null and n_pages > 0").select("file_id"), "file_id", "left_semi").where(~is_blank(F.col("text")))
    rows = good.select(F.concat_ws("/", "file_id", "page_no").alias("id"), "text", F.col("file_id").cast("string").alias("file_source"))
    cut = split_documents(rows, splitter or RecursiveSplitter(size=800, overlap=400))
    chunks.add(cut)
    counts = chunks.read().groupBy("file_source").agg(F.count("*").alias("n_chunks"))
    out = files.where("status = 'in_progress'").select("file_id", "batch_id").join(errors, "file_id", "left").join(counts, F.col("file_id").cast("string") == F.col("file_source"), "left")
    if summarise is not None:
        made = summaries(good.select(F.col("file_id").alias("file_source"), "page_no", "text"), summarise, limit)
        out = out.join(made.select(F.col("file_source").alias("file_id"), "summary"), "file_id", "left")
    else:
        out = out.withColumn("summary", F.lit(None).cast("string"))
    ok = F.col("last_error").isNull() & (F.coalesce("n_pages", F.lit(0)) > 0)
    error = F.when(~ok, F.coalesce("last_error", F.lit("no text")))
    return out.select("file_id", "batch_id", F.when(ok, "completed").otherwise("failed").alias("status"), error.alias("last_error"), F.when(ok, F.coalesce("n_chunks", F.lit(0))).otherwise(F.lit(0)).alias("n_chunks"), F.when(ok, F.col("summary")).alias("summary"))


def run_file_tasks(files: DataFrame, read: Reader, chunks: VectorTable | DocumentTable, out: str, checkpoint: str, *, once: bool = True, **options) -> StreamingQuery:
    """Handles a stream of files in progress. A micro-batch's results replace its own folder, and its chunks those of an attempt before, so a replay changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch, "files")
        chunks.delete_many(rows.select(F.col("file_id").cast("string").alias("file_source")), "file_source", "file_source")
        file_results(rows, read, chunks, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        discard(rows)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
