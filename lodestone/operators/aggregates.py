"""Counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import combined, combined_messages


def status_counts(df: DataFrame, statuses: Sequence[str], *, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """``total`` and a count for each status; of an empty table without ``by`` one row of zeros."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return (df.groupBy(*by) if by else df).agg(*counts, F.count("*").alias("total"))


def with_counts(parents: DataFrame, children: DataFrame, statuses: Sequence[str], *, key: str, child_key: str, status: str = "status") -> DataFrame:
    """Every parent with its children's counts, zeros where it has none: one aggregation and a left join."""
    counts = status_counts(children, statuses, by=[child_key], status=status).withColumnRenamed(child_key, "_k")
    out = parents.join(counts, parents[key] == counts["_k"], "left").drop("_k")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in (*statuses, "total")})


def numeric(row: DataFrame) -> tuple[dict[str, int], dict[str, float]]:
    """Integers and doubles of a one-row result by name; nulls and other types are left out."""
    got = row.first()
    whole = {f.name for f in row.schema if isinstance(f.dataType, T.IntegralType)}
    real = {f.name for f in row.schema if isinstance(f.dataType, (T.FractionalType, T.DecimalType))}
    values = got.asDict() if got else {}
    return {k: int(v) for k, v in values.items() if k in whole and v is not None}, {k: float(v) for k, v in values.items() if k in real and v is not None}


def ordered(values: Column, order: Column) -> Column:
    """An aggregate: the values of a group as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])


def combine_documents(df: DataFrame, *, by: Sequence[str] = (), text: str = "text", order: str = "rank") -> DataFrame:
    """``context``: each group's texts in order, a line end after each. Groups are contexts for a model, so small."""
    return (df.groupBy(*by) if by else df).agg(combined(ordered(F.col(text), F.col(order))).alias("context"))


def combine_messages(df: DataFrame, *, by: Sequence[str], role: str = "role", content: str = "text", order: str = "turn") -> DataFrame:
    """``chat_history``: each conversation's ``role: content`` lines in order."""
    message = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    return df.groupBy(*by).agg(combined_messages(ordered(message, F.col(order))).alias("chat_history"))


def last_state(df: DataFrame, *, by: Sequence[str], state: str, order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(state, order).alias(state))


def take_while(df: DataFrame, keep: Column, *, by: Sequence[str], order: str) -> DataFrame:
    """The rows of each group before the first that isn't kept."""
    ends = df.where(~F.coalesce(keep, F.lit(False))).groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.min(order).alias("_end"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    out = df.join(ends, same, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return out.select(*df.columns)
