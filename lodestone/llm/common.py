"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import cut_lineage, discard, scratch

__all__ = ["WORD", "boxed", "discard", "fold_of", "let", "released", "replaced", "scratch", "stored", "unboxed"]

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it: lineage ends there, lost executors cost nothing."""
    return cut_lineage(df, name)


def released() -> None:
    """Gives freed Arrow memory of a worker back to the system; workers live on after a task, and so would it."""
    pa.default_memory_pool().release_unused()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once a row although ``body`` may use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that the caller is about to add; other columns stay."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``df`` as one struct, ``row``, beside new columns, so that no names can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unboxed(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns named, out of ``row``, and more."""
    return df.select(*(F.col("row")[c].alias(c) for c in columns), *(c.alias(n) for n, c in more.items()))


def fold_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids hash as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")

