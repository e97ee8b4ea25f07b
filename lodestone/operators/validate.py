"""What is wrong with a document before it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import is_blank


def violations(df: DataFrame, schema: T.StructType, *, text: str = "text", allow_unknown: bool = True) -> Column:
    """An array of ``kind: field`` for each row: blank_text, unset, wrong_type (of values given as text), and, alike
    for all rows, missing and unknown fields. Nulls are allowed in nullable fields."""
    given = {f.name: f.dataType for f in df.schema}
    checks = [F.when(is_blank(F.col(text)), F.lit(f"blank_text: {text}"))] if text in given else [F.lit(f"missing: {text}")]
    for field in schema:
        if field.name == text:
            continue
        if field.name not in given:
            checks.append(F.lit(f"missing: {field.name}"))
            continue
        value = F.col(f"`{field.name}`")
        if not field.nullable:
            checks.append(F.when(value.isNull(), F.lit(f"unset: {field.name}")))
        if given[field.name].simpleString() != field.dataType.simpleString():
            checks.append(F.when(value.isNotNull() & value.try_cast(field.dataType).isNull(), F.lit(f"wrong_type: {field.name}")))
    if not allow_unknown:
        checks += [F.lit(f"unknown: {n}") for n in given if n not in schema.fieldNames() and n != text]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def checked(df: DataFrame, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, cast to ``schema`` and without other columns; and those that don't, with ``violations``."""
    marked = df.withColumn("violations", violations(df, schema, **options))
    present = {f.name for f in df.schema}
    good = marked.where(F.size("violations") == 0)
    good = good.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
    return good, marked.where(F.size("violations") > 0)
