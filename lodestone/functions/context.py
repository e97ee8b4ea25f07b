"""JSON contexts as VARIANT columns: made of text, read by path, changed by value, written back.

A context is a value: a column that changes one leaves the other as it was, so nothing needs to be cloned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys under which a message or a mapping is wrapped.
MESSAGE, MAPPING = "__protobuf_message__", "__mapping_data__"


def create(text: Column, *, strict: bool = True) -> Column:
    """The context of a JSON text; blank and null texts give an empty mapping. What isn't JSON fails, or is null if not ``strict``."""
    whole = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("{}")).otherwise(text)
    return F.parse_json(whole) if strict else F.try_parse_json(whole)


def create_batch(text: Column) -> Column:
    """An array of contexts: of a JSON array its elements, of any other value itself, of a blank text none."""
    whole = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("[]")).otherwise(text)
    parsed = F.parse_json(whole)
    several = F.try_variant_get(parsed, "$", "array<variant>")
    return F.when(F.ltrim(whole).startswith("["), several).otherwise(F.array(parsed))


def value(context: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.a.b[0]``; null where it is missing, null or of another kind."""
    return F.try_variant_get(context, path, kind)


def required(context: Column, path: str, kind: str = "string") -> Column:
    """As ``value``, but a missing value is an error."""
    found = F.try_variant_get(context, path, kind)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"the context has no {kind} at {path}")).cast(kind))


def fields(context: Column) -> Column:
    """A mapping's fields as a map of contexts; null for other values."""
    return F.try_variant_get(context, "$", "map<string,variant>")


def with_values(context: Column, **values: Column) -> Column:
    """A mapping with these fields set; null values are kept as JSON nulls."""
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.parse_json(F.coalesce(F.to_json(F.struct(v.alias("v"))), F.lit("{}"))))))
    new = F.transform_values(new, lambda _, v: F.coalesce(F.try_variant_get(v, "$.v", "variant"), F.parse_json(F.lit("null"))))
    old = F.map_filter(F.coalesce(fields(context), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*values))
    return F.to_variant_object(F.map_concat(old, new))


def without(context: Column, *names: str) -> Column:
    return F.to_variant_object(F.map_filter(fields(context), lambda k, _: ~k.isin(*names)))


def sanitised(context: Column) -> Column:
    """What a wrapped message or mapping stands for, wrapped fields of a mapping included; other values as they are."""

    def bare(v: Column) -> Column:
        message, mapping = F.try_variant_get(v, f"$.{MESSAGE}", "string"), F.try_variant_get(v, f"$.{MAPPING}", "variant")
        return F.coalesce(F.try_parse_json(message), mapping, v)

    top = bare(context)
    inner = fields(top)
    return F.when(inner.isNotNull(), F.to_variant_object(F.transform_values(inner, lambda _, v: bare(v)))).otherwise(top)


def dumped(context: Column) -> Column:
    """A context as JSON text, fields in order of their names."""
    return F.to_json(context)


def optional(context: Column, path: str, kind: str, condition: Callable[[Column], Column]) -> Column:
    """A predicate that holds for all rows where the context has no value at the path, or a blank text, and is ``condition(value)`` elsewhere."""
    found = value(context, path, kind)
    absent = found.isNull() | (F.trim(found) == "") if kind == "string" else found.isNull()
    return absent | F.coalesce(condition(found), F.lit(False))
