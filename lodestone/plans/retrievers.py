"""Retrievers over two stores: whole documents in one, what is searched for them in the other.

A retriever takes documents in, finds and removes them. What is embedded for a document, its children, is a
step of the caller's: its chunks, a summary, or the questions that it answers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.operators.chunking import RecursiveSplitter, Splitter, split_documents
from lodestone.operators.filters import Filter, Term, Terms, where
from lodestone.operators.segments import SegmentIndex
from lodestone.plans.chains import Step, lines_of
from lodestone.store import Added, DocumentTable, Registry, VectorTable


class Retriever(Protocol):
    def ingest(self, docs: DataFrame) -> Added: ...

    def retrieve(self, query: Sequence[float], k: int = 0, by: Filter | None = None) -> DataFrame: ...

    def remove(self, which: Sequence[str] | Filter) -> int: ...


def chunk_children(splitter: Splitter) -> Step:
    """A child for each chunk."""
    return lambda docs: split_documents(docs, splitter)


def chunk_sizes(sizes: Sequence[int], length: Callable[[str], int] = len, overlap: int = 0) -> Step:
    """Children by several chunk sizes at once, in characters or by another length, such as tokens."""

    def step(docs: DataFrame) -> DataFrame:
        out = None
        for size in sizes:
            part = split_documents(docs, RecursiveSplitter(size=size, overlap=overlap, length=length))
            part = part.withColumn("id", F.sha2(F.concat_ws("/", "id", F.lit(str(size))).cast("binary"), 256))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no sizes")
        return out

    return step


def _child(docs: DataFrame, text: Column, number: Column) -> DataFrame:
    own = {"parent_doc_id": F.col("id"), "page_no": number.cast("int"), "start_index": F.lit(None).cast("int"), "end_index": F.lit(None).cast("int")}
    ident = F.sha2(F.concat_ws("/", F.col("id"), number.cast("string")).cast("binary"), 256)
    others = [c for c in docs.columns if c not in ("id", "text", *own)]
    return docs.select(ident.alias("id"), text.alias("text"), *others, *(c.alias(n) for n, c in own.items()))


def summary_children(summarise: Callable[[Column], Column]) -> Step:
    """One child, a summary."""
    return lambda docs: _child(docs, summarise(F.col("text")), F.lit(1))


def question_children(ask: Callable[[Column], Column]) -> Step:
    """A child for each line of a model's answer: the questions that a document answers, each once."""

    def step(docs: DataFrame) -> DataFrame:
        asked = docs.select("*", F.posexplode(F.array_distinct(lines_of(ask(F.col("text"))))).alias("_n", "_q"))
        return _child(asked, F.col("_q"), F.col("_n") + 1).drop("_n", "_q")

    return step


class MultiVectorRetriever:
    """Documents found by their children: search finds children, their documents come back once each, best first."""

    def __init__(self, documents: DocumentTable, vectors: VectorTable, children: Step) -> None:
        self.documents, self.vectors, self.children = documents, vectors, children

    def ingest(self, docs: DataFrame) -> Added:
        added = self.documents.add(docs)
        self.vectors.add(self.children(self.documents.get_many(added.ids)))
        return added

    def retrieve(self, query: Sequence[float], k: int = 0, by: Filter | None = None) -> DataFrame:
        return retrieval.ranked_parents(self.vectors.search(query, k, by), self.documents.read())

    def remove(self, which: Sequence[str] | Filter) -> int:
        """Documents, by ids or by a filter on them, and all their children; gives the number of documents."""
        gone = where(self.documents.read(), Terms("id", list(which)) if isinstance(which, Sequence) else which).select("id")
        self.vectors.delete_many(gone, "id", "parent_doc_id")
        return self.documents.delete_many(gone)


class KeywordRetriever:
    """Documents found by their words, over an index that follows the table: English stems and no stop words, unless told otherwise."""

    def __init__(self, documents: DocumentTable, index: SegmentIndex) -> None:
        self.documents, self.index = documents, index

    def ingest(self, docs: DataFrame) -> Added:
        added = self.documents.add(docs)
        self.index.ingest(self.documents.get_many(added.ids))
        return added

    def retrieve(self, query: str, k: int = 10, by: Filter | None = None) -> DataFrame:
        rows = where(self.documents.read(), by)
        found = self.index.top_k(query, k, rows if by is not None else None)
        return rows.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id").limit(k)

    def remove(self, by: Filter) -> int:
        gone = where(self.documents.read(), by).select("id")
        self.index.remove(gone)
        return self.documents.delete_many(gone)


class RetrieverOperator:
    """Retrievers by instance: one vector table each, and one document table for all, told apart by ``vs_id``.

    Documents are kept whole, or as parents of ``parent_size`` characters; what is searched are their children of ``child_size``
    in ``length``, which counts characters or tokens.
    """

    def __init__(
        self, registry: Registry, documents: DocumentTable, embed: Callable[[Column], Column], dimension: int, *, parent_size: int = 0, child_size: int = 800, child_overlap: int = 400,
        length: Callable[[str], int] = len,
    ) -> None:
        missing = {"parent_doc_id", "vs_id"} - set(documents.fields.fieldNames())
        if missing:
            raise ValueError(f"the documents have no {', '.join(sorted(missing))}")
        if not 0 <= child_overlap <= child_size or child_size < 1 or 0 < parent_size <= child_size:
            raise ValueError("children are longer than what they share, and parents longer than children")
        self.registry, self.documents, self.embed, self.dimension = registry, documents, embed, dimension
        self.parent_size, self.children = parent_size, chunk_children(RecursiveSplitter(size=child_size, overlap=child_overlap, length=length))

    def provision(self, instance: str) -> VectorTable:
        return self.registry.create(instance, self.embed, self.dimension, self.documents.fields)

    def cleanup(self, instance: str) -> bool:
        """Deletes an instance's documents and its vectors; whether there was such an instance."""
        self.documents.delete_where(Term("vs_id", instance))
        return self.registry.remove(instance)

    def writer(self, instance: str) -> MultiVectorRetriever:
        """The retriever that takes documents in."""
        vectors = self.registry.load(instance, self.embed, self.dimension)
        if vectors is None:
            raise ValueError(f"no instance {instance}")
        return _Tenant(self.documents, vectors, self.children, instance, self.parent_size)

    def reader(self, instances: Sequence[str], score: Column) -> Callable[..., DataFrame]:
        """``search(query, k)`` over several instances: the documents of one as they come, of more all those found, reranked by ``score``."""
        if not instances:
            raise ValueError("no instances")
        each = [self.writer(i) for i in instances]
        return lambda query, k=10: retrieval.multi_path([r.retrieve(query, k) for r in each], score, k)


class _Tenant(MultiVectorRetriever):
    """Of the shared documents those of one instance."""

    def __init__(self, documents: DocumentTable, vectors: VectorTable, children: Step, instance: str, parent_size: int) -> None:
        super().__init__(documents, vectors, children)
        self.instance, self.parent_size = instance, parent_size

    def ingest(self, docs: DataFrame) -> Added:
        if self.parent_size:
            docs = split_documents(docs, RecursiveSplitter(size=self.parent_size, overlap=0))
        return super().ingest(docs.withColumn("vs_id", F.lit(self.instance)))

    def retrieve(self, query: Sequence[float], k: int = 0, by: Filter | None = None) -> DataFrame:
        own = where(self.documents.read(), Term("vs_id", self.instance))
        return retrieval.ranked_parents(self.vectors.search(query, k, by), own)
