"""BM25 keyword search over an inverted index kept as tables.

Building tokenises the corpus once and writes two tables below the shared folder: ``terms`` (id, term, tf,
length), dealt into folders by a hash of the term and sorted by term inside, and ``lengths`` (id, length).
A query reads the folders of its own words, and of these the row groups that hold them; the statistics of
the corpus are kept with the index.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.stem import stem, stems
from lodestone.functions.text import ACCENTED, PLAIN, strip_accents
from lodestone.operators.filters import Filter, where
from lodestone.plans.lineage import cut_lineage, discard, scratch

IGNORE = r"(\\.|[^a-z])+"
#: Common English function words. Other lists are a parameter.
ENGLISH = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does
    doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just
    me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the
    their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who
    whom why will with would you your yours yourself yourselves""".split()
)


def _spaced(text: Column, ignore: str) -> Column:
    """Words without accents, in lower case, with spaces between them."""
    return F.regexp_replace(F.lower(strip_accents(text)), ignore, " ")


def tokens(text: Column, stopwords: frozenset[str] = frozenset(), ignore: str = IGNORE, stemming: bool = False) -> Column:
    """Words without accents, in lower case, no stop words, as stems if asked for; what ``ignore`` matches separates them."""
    words = F.split(_spaced(text, ignore), " ")
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords) if stopwords else w != "")
    return stems(words) if stemming else words


_ACCENTS, _LETTERS, _IGNORED = str.maketrans(ACCENTED, PLAIN), re.compile("[a-z]+"), re.compile(IGNORE)


def _plain_words(text: str) -> list[str]:
    """The words of a text that ``IGNORE`` leaves."""
    text = text.lower() if text.isascii() else text.translate(_ACCENTS).lower()
    return _IGNORED.sub(" ", text).split(" ") if "\\" in text else _LETTERS.findall(text)


def counted(text: Column, stopwords: frozenset[str] = frozenset(), ignore: str = IGNORE, stemming: bool = False) -> Column:
    """``length, terms, tfs``: how many words ``tokens`` gives of a text, the distinct ones, and how often each is there; of a null text none."""

    @F.arrow_udf(T.StructType().add("length", "long").add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.IntegerType())))
    def counts(column: pa.Array) -> pa.Array:
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        lengths, terms, tfs, ends = [], array("i"), array("i"), [0]
        for t in column:
            found = Counter(_plain_words(t.as_py() or "") if ignore == IGNORE else (t.as_py() or "").split(" "))
            for w in ("", *stopwords) if len(stopwords) < len(found) else [w for w in found if not w or w in stopwords]:
                found.pop(w, None)
            if stemming:
                plain, found = found, Counter()
                for w, n in plain.items():
                    found[stem(w)] += n
            terms.extend(map(numbers.__getitem__, found))
            tfs.extend(found.values())
            lengths.append(found.total())
            ends.append(len(terms))
        at, words = pa.array(ends, pa.int32()), pa.array(list(numbers), pa.string())
        lists = [pa.ListArray.from_arrays(at, words.take(pa.array(terms, pa.int32()))), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), *lists], ["length", "terms", "tfs"])

    return counts(text if ignore == IGNORE else _spaced(text, ignore))


def query_tokens(query: str, stopwords: frozenset[str] = frozenset(), ignore: str = IGNORE, stemming: bool = False) -> list[str]:
    """The distinct words of a query, as ``tokens`` makes them, in order."""
    plain = query.translate(str.maketrans(ACCENTED, PLAIN)).lower()
    words = (w for w in re.sub(ignore, " ", plain).split(" ") if w and w not in stopwords)
    return list(dict.fromkeys(map(stem, words) if stemming else words))


@dataclass(frozen=True)
class Index:
    terms: DataFrame
    lengths: DataFrame
    documents: int
    mean_length: float
    folders: int
    stopwords: frozenset[str] = frozenset()
    ignore: str = IGNORE
    stemming: bool = False


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.hash(term), F.lit(folders))


def build(
    docs: DataFrame, *, text: str = "text", key: str = "id", stopwords: frozenset[str] = frozenset(), ignore: str = IGNORE, stemming: bool = False,
    folders: int = 16, path: str | None = None,
) -> Index:
    """Null texts have no words and length 0. A text's words are counted where it is read, so nothing is shuffled.

    The index is written below ``path``, by default in the folder that goes when the application ends. More ``folders`` let a query
    read less of a large index. A folder's rows are dealt to as many tasks as read the documents,
    so that no common term is one task's alone.
    """
    spark = docs.sparkSession
    path = (path or scratch(spark, "bm25")).rstrip("/")
    words = docs.select(F.col(key).alias("id"), counted(F.col(text), stopwords, ignore, stemming).alias("w"))
    words = cut_lineage(words.select("id", "w.length", F.arrays_zip("w.terms", "w.tfs").alias("w")), "bm25-words")
    words.select("id", "length").write.parquet(f"{path}/lengths")
    terms = words.select("id", "length", F.explode("w").alias("w")).select("id", "length", F.col("w.terms").alias("term"), F.col("w.tfs").cast("bigint").alias("tf"))
    terms = terms.withColumn("folder", _folder(F.col("term"), folders))
    terms.sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/terms")
    discard(words)
    lengths = spark.read.schema(words.select("id", "length").schema).parquet(f"{path}/lengths")
    total = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return Index(spark.read.schema(terms.schema).parquet(f"{path}/terms"), lengths, total["n"], total["mean"] or 1.0, folders, stopwords, ignore, stemming)


def score(index: Index, query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of the documents that hold any word of the query."""
    asked = query_tokens(query, index.stopwords, index.ignore, index.stemming)
    rows, spark = index.terms, index.terms.sparkSession
    held = sorted({r["f"] for r in spark.createDataFrame([(w,) for w in asked], "term string").select(_folder(F.col("term"), index.folders).alias("f")).collect()})
    hits = rows.where(F.col("folder").isin(held) & F.col("term").isin(asked)) if asked else rows.where(F.lit(False))
    found = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    weights = {t: math.log((index.documents - df + 0.5) / (df + 0.5) + 1) for t, df in found.items()}
    idf = F.lit(0.0)
    for t in sorted(weights):
        idf = F.when(F.col("term") == t, F.lit(weights[t])).otherwise(idf)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / index.mean_length))
    return hits.groupBy("id").agg(F.sum(part).alias("score"))


def top_k(docs: DataFrame, index: Index, query: str, k: int = 10, by: Filter | None = None, *, key: str = "id", **options) -> DataFrame:
    """The k documents with the best scores, ``score`` added, ties by key; statistics are of the whole index.

    Ranking moves ids and scores only: the documents' other columns are fetched for the k that are left.
    """
    scored = score(index, query, **options)
    rows = where(docs, by)
    if by is not None:
        scored = scored.join(rows.select(F.col(key).alias("id")), "id", "left_semi")
    best = scored.orderBy(F.desc("score"), "id").limit(k).withColumnRenamed("id", "_id")
    return rows.join(F.broadcast(best), rows[key] == best["_id"]).drop("_id").orderBy(F.desc("score"), key).limit(k)
