"""From ``documents`` to token files: filter by quality, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next one. All but the last return the columns of documents, whatever their names: what a stage adds
on the way is kept apart from them. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, neardup, quality, records
from lodestone.llm.common import boxed, discard, fold_of, scratch, stored, unboxed

#: Documents that score less than this are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labels outside fold 0.

    Null and empty texts score as a text without words does. Repeated rows score alike, so all of them stay or
    go, null ids among them; a score at the bound stays. Very long texts are scored whole.
    """
    model = quality.fit_ranking(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=fold_of("doc_id", 5) != 0, threshold=LEAST_QUALITY)
    scored = quality.score_quality(boxed(docs, text=F.col("text")), model)
    return unboxed(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id.

    A null id comes before all others, and ids alike are told apart by a hash of their texts; of rows alike in
    both any one stays. Null, empty and blank texts are one class. Very long texts are compared whole.
    """
    return neardup.deduplicated(docs, shingle=5, least=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item whole.

    Null and empty texts hold none and stay, and so do all documents where the table of items is empty; null
    items and items without words match nothing. Repeated rows and rows with null ids are each judged by their
    own text. Very long texts are scanned whole.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to weights 5, 2, 1, 150 % of all words; a document may stand twice, or not at all.

    Null and empty texts have no words and cost nothing. Null sources are one source, the last. Ties of keys go
    by id, size and a hash of the row, so reruns agree; rows alike in all columns are interchangeable.
    """
    return mixing.mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes all documents into record files in order of id, and returns what the files hold.

    Null ids come first; null and empty texts are the end id alone; repeated rows each have a record, those
    with one id in no defined order. Very long texts are one record.
    """
    import public_tokenizers

    tokenizer, path = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "records")
    records.write_records(docs, path, tokenizer=tokenizer, end_id=2)
    return records.read_records(spark, path, width=records.token_width(tokenizer), ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_files", write_token_files),
]

#: SQL can't express the classifier and the signatures; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
