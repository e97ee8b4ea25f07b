"""Document schemas: an id, a text, an optional vector, then one typed column for each metadata field."""

from __future__ import annotations

from pyspark.sql import types as T

#: Column types that a metadata field may have.
FIELD_TYPES: dict[str, T.DataType] = {
    "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "varchar": T.StringType(),
}
ROOT = "ROOT"


def metadata(**fields: str) -> T.StructType:
    """Metadata fields by name and type, in order: ``metadata(page_no="int32")``."""
    out = T.StructType()
    for name, kind in fields.items():
        if kind not in FIELD_TYPES:
            raise ValueError(f"{name}: {kind} is none of {', '.join(FIELD_TYPES)}")
        out = out.add(name, FIELD_TYPES[kind])
    return out


def described(schema: T.StructType, **comments: str) -> T.StructType:
    """``schema`` with comments on the named fields."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "comment": comments[f.name]} if f.name in comments else f.metadata) for f in schema])


#: Where a document or chunk comes from.
PRESET = metadata(parent_doc_id="varchar", page_no="int32", file_source="varchar", start_index="int32", end_index="int32")
#: PRESET with the vector store that a chunk belongs to, to partition by.
TENANT = T.StructType([*PRESET, T.StructField("vs_id", T.StringType())])


def document(fields: T.StructType = PRESET, vector: bool = False) -> T.StructType:
    """The whole schema of a document table, or of a vector table."""
    out = T.StructType().add("id", T.StringType(), False).add("text", T.StringType(), False)
    if vector:
        out = out.add("vector", T.ArrayType(T.FloatType()), False)
    return T.StructType([*out, *fields])
