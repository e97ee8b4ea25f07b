"""Files to document rows.

Every reader gives ``text, parent_doc_id, page_no, file_source, start_index, end_index``; files are read by
Spark's own sources, so any file system it knows will do, and formats that it lacks are parsed in tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import Splitter, split_documents
from lodestone.plans.lineage import numbered
from lodestone.types import FIELD_TYPES, PRESET, ROOT

Hook = Callable[[DataFrame], DataFrame]


def preset(df: DataFrame, page_no: Column, source: Column, text: str = "text") -> DataFrame:
    """Adds the preset columns of a whole document; a document's indexes span its UTF-8 bytes."""
    return df.select(
        F.col(text).alias("text"), F.lit(ROOT).alias("parent_doc_id"), page_no.cast("int").alias("page_no"), source.alias("file_source"),
        F.lit(0).alias("start_index"), F.octet_length(text).cast("int").alias("end_index"),
    )


def text_files(spark: SparkSession, path: str | Sequence[str], *, source: str | None = None, **options: str) -> DataFrame:
    """A document for each text or Markdown file."""
    rows = spark.read.options(**options).text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("p"))
    return preset(rows, F.lit(1), F.lit(source) if source else F.col("p"))


def _pages(spark: SparkSession, path: str | Sequence[str], parse: Callable[[bytes], Iterator[str]], source: str | None, options: dict[str, str]) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = list(parse(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array([name] * len(texts), pa.string())], ["text", "page", "p"])

    rows = spark.read.format("binaryFile").options(**options).load(path).select("path", "content").mapInArrow(read, "text string, page int, p string")
    return preset(rows, F.col("page"), F.lit(source) if source else F.col("p"))


def docx_texts(content: bytes, paragraphs: int = 20) -> Iterator[str]:
    """The text of each ``paragraphs`` paragraphs of a DOCX file; blank stretches are left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    all_of = list(body.iter(f"{w}p"))
    for i in range(0, len(all_of), paragraphs):
        text = "".join(t.text or "" for p in all_of[i : i + paragraphs] for t in p.iter(f"{w}t"))
        if text.strip():
            yield text


def docx_files(spark: SparkSession, path: str | Sequence[str], *, paragraphs: int = 20, source: str | None = None, **options: str) -> DataFrame:
    return _pages(spark, path, lambda content: docx_texts(content, paragraphs), source, options)


def pdf_files(spark: SparkSession, path: str | Sequence[str], *, source: str | None = None, password: str | None = None, **options: str) -> DataFrame:
    """A document for each page. Needs the pypdf package, which is looked for when this is called."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e
    return _pages(spark, path, lambda content: (p.extract_text() for p in pypdf.PdfReader(io.BytesIO(content), password=password).pages), source, options)


def column_mapping(mapping: str) -> list[tuple[int, str, str | None, str | None]]:
    """``"0:t,1:m:name:int64"`` as (column, "text" or "metadata", name, type) rows."""
    out = []
    for part in mapping.split(","):
        bits = part.strip().split(":")
        kind = {"t": "text", "txt": "text", "text": "text", "m": "metadata", "metadata": "metadata"}.get(bits[1] if len(bits) > 1 else "")
        if not bits[0].isdigit() or kind is None or (kind == "metadata" and (len(bits) != 4 or bits[3] not in FIELD_TYPES)):
            raise ValueError(f"can't read the mapping {part!r}")
        out.append((int(bits[0]), kind, *(bits[2:4] if kind == "metadata" else (None, None))))
    if not any(kind == "text" for _, kind, _, _ in out):
        raise ValueError("a mapping needs a text column")
    return out


def parquet_files(spark: SparkSession, path: str | Sequence[str], mapping: str, *, limit: int = 0, order: str | None = None) -> DataFrame:
    """Columns by place, as mapped; presets that aren't mapped get their defaults.

    ``page_no`` numbers rows from 1, by ``order`` where one is given, else as they are read.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df.limit(limit) if limit > 0 else df
    names = df.columns
    df = numbered(df, order, "_number")
    number = F.col("_number")
    found, texts = {}, []
    for i, kind, name, type_ in column_mapping(mapping):
        column = F.col(f"`{names[i]}`")
        if kind == "text":
            texts.append(column.cast("string"))
        else:
            found[name] = column.cast(FIELD_TYPES[type_])
    defaults = {"parent_doc_id": F.lit(ROOT), "page_no": number.cast("int"), "file_source": F.lit(""), "start_index": F.lit(0), "end_index": F.lit(0)}
    extra = {n: c for n, c in found.items() if n not in defaults}
    return df.select(F.concat(*texts).alias("text"), *((found.get(f.name, defaults[f.name])).cast(f.dataType).alias(f.name) for f in PRESET), *(c.alias(n) for n, c in extra.items()))


READERS: dict[str, Callable[..., DataFrame]] = {"txt": text_files, "md": text_files, "docx": docx_files, "pdf": pdf_files}


def reader_for(name: str, *, strict: bool = False) -> Callable[..., DataFrame] | None:
    """The reader for a file name or type."""
    found = READERS.get(name.rsplit(".", 1)[-1].lower())
    if found is None and strict:
        raise ValueError(f"no reader for {name}")
    return found


def _mapped_rows(spark: SparkSession, path: str, mapping: str, **options: str) -> DataFrame:
    """The mapped text columns of Parquet files of any other columns, numbered inside each file; ``file_source`` is the file."""
    columns = column_mapping(mapping)
    rows = spark.read.options(**options).parquet(path)
    texts = F.concat(*(F.col(f"`{rows.columns[i]}`").cast("string") for i, kind, _, _ in columns if kind == "text"))
    found = rows.select(texts.alias("text"), F.struct(F.col("_metadata.file_path").alias("p"), F.monotonically_increasing_id().alias("i")).alias("o"))
    found = numbered(found, "o", "_n").select("text", F.col("o.p").alias("p"), "_n")
    first = found.groupBy("p").agg(F.min("_n").alias("_first"))
    return preset(found.join(first, "p"), F.col("_n") - F.col("_first") + 1, F.col("p"))


def directory(spark: SparkSession, path: str, *, recursive: bool = True, pattern: str | None = None, types: Sequence[str] = ("txt", "md", "docx"), mapping: str = "0:t") -> DataFrame:
    """Documents of all files below ``path`` whose full path matches ``pattern`` somewhere; rows of Parquet files by ``mapping``.

    Each reader scans its own types, found by Spark's listing; no names reach the driver's Python.
    """
    if "parquet" in (t.lower() for t in types):
        rows = _mapped_rows(spark, path, mapping, recursiveFileLookup=str(recursive).lower(), pathGlobFilter="*.[pP][aA][rR][qQ][uU][eE][tT]")
        rest = [t for t in types if t.lower() != "parquet"]
        if rest:
            rows = rows.unionByName(directory(spark, path, recursive=recursive, types=rest))
        return rows.where(F.col("file_source").rlike(pattern)) if pattern else rows
    groups: dict[Callable, list[str]] = {}
    for t in types:
        groups.setdefault(reader_for(t, strict=True), []).append("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t))
    parts = [read(spark, path, recursiveFileLookup=str(recursive).lower(), pathGlobFilter=f"*.{{{','.join(globs)}}}") for read, globs in groups.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.where(F.col("file_source").rlike(pattern)) if pattern else out


def load(df: DataFrame, splitter: Splitter | None = None, hook: Hook | None = None) -> DataFrame:
    """Read documents, after a hook of the caller's, whole or in chunks."""
    out = df.transform(hook) if hook else df
    if splitter is None:
        return out
    ident = F.sha2(F.concat_ws("/", "file_source", F.col("page_no").cast("string")).cast("binary"), 256)
    return split_documents(out.withColumn("id", ident), splitter, keep_parent=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, md5, sha1, sha256 of files, computed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def object_key(purpose: Column, file_id: Column) -> Column:
    """``purpose/bucket/id``, ten buckets by the id's last character."""
    return F.concat_ws("/", purpose, F.pmod(F.ascii(F.right(file_id, F.lit(1))), F.lit(10)).cast("string"), file_id)
