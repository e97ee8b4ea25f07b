"""Metadata filters, sorters and pages as Spark columns and frames.

A filter is a tree of small objects that becomes one Column, so predicates reach the scan and three-valued
logic is Spark's: a comparison with null is null and keeps no row, and neither does its negation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """``name = value``; a null value matches no row."""

    name: str
    value: Any

    def column(self) -> Column:
        return F.col(self.name) == F.lit(self.value)


@dataclass(frozen=True)
class Terms:
    """``name`` is one of ``values``; of none, no row."""

    name: str
    values: Sequence[Any]

    def column(self) -> Column:
        return F.col(self.name).isin(list(self.values)) if self.values else F.lit(False)


@dataclass(frozen=True)
class Range:
    """Bounds on a number; both are exclusive unless said otherwise, and without bounds every row matches."""

    name: str
    start: float | None = None
    stop: float | None = None
    inclusive_start: bool = False
    inclusive_stop: bool = False

    def column(self) -> Column:
        c, parts = F.col(self.name), []
        if self.start is not None:
            parts.append(c >= self.start if self.inclusive_start else c > self.start)
        if self.stop is not None:
            parts.append(c <= self.stop if self.inclusive_stop else c < self.stop)
        return reduce(Column.__and__, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Bool:
    """All of ``must``, at least one of ``should`` if there is any, and none of ``must_not``."""

    must: Sequence[Filter] = ()
    should: Sequence[Filter] = ()
    must_not: Sequence[Filter] = ()

    def column(self) -> Column:
        parts = [f.column() for f in self.must]
        if self.should:
            parts.append(reduce(Column.__or__, (f.column() for f in self.should)))
        parts += [~f.column() for f in self.must_not]
        return reduce(Column.__and__, parts) if parts else F.lit(True)


Filter = Term | Terms | Range | Bool


def where(df: DataFrame, by: Filter | None) -> DataFrame:
    return df if by is None else df.where(by.column())


def without(df: DataFrame, by: Filter | None) -> DataFrame:
    """The rows that deleting by a filter leaves: those where it is false or null. No filter leaves none."""
    return df.where(~F.coalesce(by.column(), F.lit(False))) if by is not None else df.where(F.lit(False))


@dataclass(frozen=True)
class Sorter:
    """Nulls come last either way."""

    name: str
    descending: bool = True

    def column(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_last()


@dataclass(frozen=True)
class Find:
    """A filter, an order, and a window of rows; 0 means no limit or no offset."""

    filter: Filter | None = None
    sorters: Sequence[Sorter] = field(default_factory=tuple)
    limit: int = 0
    offset: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        out = where(df, self.filter)
        if self.sorters:
            out = out.orderBy(*(s.column() for s in self.sorters))
        if self.offset > 0:
            out = out.offset(self.offset)
        return out.limit(self.limit) if self.limit > 0 else out


def by_ids(df: DataFrame, ids: Sequence[Any], column: str = "id") -> DataFrame:
    """Rows whose id is among ``ids``; none for no ids."""
    return df.where(F.col(column).isin(list(ids))) if ids else df.where(F.lit(False))


def page(
    df: DataFrame, *, limit: int = 20, after: tuple | None = None, before: tuple | None = None, descending: bool = True,
    created: str = "created_at", key: str = "id",
) -> DataFrame:
    """One page by (created, key), with ``has_more`` on each row.

    ``after`` and ``before`` are (created, key) of the last row of the page before and the first of the page
    after, in the order shown. One row more than ``limit`` is read to tell whether there is more.
    """
    place = F.struct(F.col(created), F.col(key))
    cursor = lambda at: F.struct(F.lit(at[0]).alias(created), F.lit(at[1]).alias(key))
    out = df
    if after is not None:
        out = out.where(place < cursor(after) if descending else place > cursor(after))
    if before is not None:
        out = out.where(place > cursor(before) if descending else place < cursor(before))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (created, key)]
    rows = out.orderBy(*order).limit(limit + 1)
    numbered = rows.withColumns({"_at": F.expr(f"row_number() over (order by {', '.join(f'{c} {"desc" if descending else "asc"}' for c in (created, key))})"), "_n": F.expr("count(1) over ()")})
    return numbered.where(F.col("_at") <= limit).withColumn("has_more", F.col("_n") > limit).drop("_at", "_n")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, summed up before rows are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_m"))
    return top.select(*(F.col(c) if c in keys else F.col("_m")[c].alias(c) for c in df.columns))
