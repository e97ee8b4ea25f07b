"""Document and vector tables, in the session's warehouse folder.

Each is a ``SnapshotTable``: an append, delete or update is one commit, whole or absent, older versions can be
read, and a delete or update rewrites only the files that hold rows it matches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vector import cosine, norm
from lodestone.operators import search
from lodestone.operators.filters import Filter, Find, by_ids, where
from lodestone.operators.validate import checked
from lodestone.plans.lineage import cut_lineage, discard
from lodestone.snapshots import SnapshotTable
from lodestone.types import PRESET, document


def warehouse_path(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone/{name}"


@dataclass(frozen=True)
class Added:
    """What an append did: rows written, their ids, and the rows refused, with their violations."""

    affected_rows: int
    ids: DataFrame
    failed: DataFrame


class DocumentTable:
    """Documents with typed metadata: ``id``, ``text`` and the given fields."""

    has_vector = False

    def __init__(self, spark: SparkSession, name: str, fields: T.StructType = PRESET, *, replace: bool = False) -> None:
        self.spark, self.name, self.fields = spark, name, fields
        self.schema = document(fields, self.has_vector)
        self.table = SnapshotTable(spark, warehouse_path(spark, name), self._stored(), replace=replace)

    def _stored(self) -> T.StructType:
        return self.schema

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version or the one asked for, as it is now: later commits don't change what was read."""
        return self.table.read(version)

    def _prepared(self, docs: DataFrame) -> DataFrame:
        return docs

    def add(self, docs: DataFrame, *, allow_unknown: bool = True) -> Added:
        """Appends the rows that fit the schema, all or, after an error, none. Without ids they get hashes of a batch mark and their content."""
        if "id" not in docs.columns:
            content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
            docs = docs.withColumn("id", F.sha2(F.concat(F.lit(uuid.uuid4().hex), content, F.monotonically_increasing_id().cast("string")).cast("binary"), 256))
        good, failed = checked(self._prepared(docs), self._stored(), allow_unknown=allow_unknown)
        # The batch is computed once, as it is written, so its ids are those in the table.
        _, files = self.table.append(good)
        return Added(sum(files.values()), self.table.files(files).select("id"), failed)

    def get(self, ids: Sequence[str]) -> DataFrame:
        return by_ids(self.read(), ids)

    def get_many(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """For ids in a table of any size."""
        return self.read().join(ids.select(F.col(column).alias("id")).distinct(), "id", "left_semi")

    def find(self, request: Find) -> DataFrame:
        return request.apply(self.read().select(*(f.name for f in document(self.fields))))

    def count(self, by: Filter | None = None) -> int:
        """Without a filter the manifests tell, and nothing is read."""
        return self.table.snapshot().rows if by is None else where(self.read(), by).count()

    def delete(self, ids: Sequence[str]) -> int:
        if not ids:
            raise ValueError("no ids to delete")
        return self._delete(F.col("id").isin(list(ids)))

    def delete_many(self, ids: DataFrame, column: str = "id", of: str = "id") -> int:
        """For ids in a table of any size, which the column ``of`` of this one holds."""
        gone = cut_lineage(ids.select(F.col(column).cast("string").alias(of)).distinct(), "ids")
        try:
            return self.table.rewrite(lambda df: df.join(gone, of, "left_semi"), lambda df: df.join(gone, of, "left_anti"), "delete")
        finally:
            discard(gone)

    def delete_where(self, by: Filter | None = None) -> int:
        """Deletes what the filter matches; without one, everything."""
        hit = by.column() if by is not None else None
        return self.table.clear() if hit is None else self._delete(hit)

    def _delete(self, hit: Column) -> int:
        sure = F.coalesce(hit, F.lit(False))
        return self.table.rewrite(lambda df: df.where(hit), lambda df: df.where(~sure), "delete")

    def update(self, change: dict[str, Column], by: Filter) -> int:
        """New values for some columns where the filter matches; returns how many rows it matched."""
        hit = F.coalesce(by.column(), F.lit(False))
        new = lambda df: df.select(*(F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in df.columns))
        return self.table.rewrite(lambda df: df.where(hit), new, "update")

    def drop(self) -> None:
        self.table.drop()


class VectorTable(DocumentTable):
    """Documents with vectors of one dimension, embedded on writing; ``norm`` is kept beside each vector."""

    has_vector = True

    def __init__(self, spark: SparkSession, name: str, embed: Callable[[Column], Column], dimension: int, fields: T.StructType = PRESET, **options) -> None:
        if not 0 < dimension < 10_000:
            raise ValueError("a dimension is between 1 and 9999")
        self.embed, self.dimension = embed, dimension
        super().__init__(spark, name, fields, **options)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema, T.StructField("norm", T.DoubleType())])

    def _prepared(self, docs: DataFrame) -> DataFrame:
        vectors = docs if "vector" in docs.columns else docs.withColumn("vector", self.embed(F.col("text")))
        fit = F.when(F.size("vector") == self.dimension, F.col("vector").cast("array<float>"))
        return vectors.withColumn("vector", fit).withColumn("norm", norm(F.col("vector")))

    def search(self, query: Sequence[float], k: int = 0, by: Filter | None = None) -> DataFrame:
        """The k nearest rows that the filter matches; the filter reaches the scan, the kept norms save half the work."""
        if len(query) != self.dimension:
            raise ValueError(f"a query has {self.dimension} numbers")
        length = float(sum(x * x for x in query) ** 0.5)
        similar = cosine(F.col("vector"), search.literal(query), F.col("norm"), F.lit(length))
        rows = where(self.read(), by).withColumn("similarity", similar).where(F.col("similarity").isNotNull())
        return rows.drop("vector", "norm").orderBy(F.desc("similarity"), "id").limit(search.clamped(k))


class Registry:
    """Vector tables by instance id, their schema kept as JSON, in one table."""

    SCHEMA = T.StructType().add("instance_id", "string").add("metadata_schema", "string").add("embedding_table_name", "string").add("custom", "string").add("created_at", "timestamp")

    def __init__(self, spark: SparkSession, name: str = "vector_store_metadata") -> None:
        self.spark, self.table = spark, SnapshotTable(spark, warehouse_path(spark, name), self.SCHEMA)

    def list(self) -> DataFrame:
        return self.table.read()

    @staticmethod
    def table_of(instance_id: str) -> str:
        return f"vs_{hashlib.sha256(instance_id.encode()).hexdigest()}"

    def create(self, instance_id: str, embed, dimension: int, fields: T.StructType = PRESET, custom: str | None = None) -> VectorTable:
        if self._row(instance_id):
            raise ValueError(f"{instance_id} exists")
        row = self.spark.createDataFrame([(instance_id, fields.json(), self.table_of(instance_id), custom)], "instance_id string, metadata_schema string, embedding_table_name string, custom string")
        self.table.append(row.withColumn("created_at", F.current_timestamp()))
        return VectorTable(self.spark, self.table_of(instance_id), embed, dimension, fields)

    def _row(self, instance_id: str):
        return self.list().where(F.col("instance_id") == instance_id).first()

    def load(self, instance_id: str, embed, dimension: int) -> VectorTable | None:
        row = self._row(instance_id)
        return VectorTable(self.spark, row["embedding_table_name"], embed, dimension, T.StructType.fromJson(json.loads(row["metadata_schema"]))) if row else None

    def remove(self, instance_id: str) -> bool:
        row = self._row(instance_id)
        if row:
            own = F.col("instance_id") == instance_id
            self.table.rewrite(lambda df: df.where(own), lambda df: df.where(~own), "delete")
            SnapshotTable(self.spark, warehouse_path(self.spark, row["embedding_table_name"])).drop()
        return bool(row)
