"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a sequence of records::

    length    8 bytes  little-endian, bytes of payload
    check     4 bytes  masked crc32 of those 8 bytes
    payload   1 byte: 1 if the document has an id, else 0; its id, 8 bytes, signed;
              then token ids, 2 or 4 bytes each; all little-endian
    check     4 bytes  masked crc32 of the payload

The mask rotates a checksum right by 15 bits and adds a constant, so that checksums of data which
itself holds checksums stay useful. Shards are in ascending order of the ids of the documents, and so
are the records inside. Each write attempt of a task makes a file of its own name; the index, a
Parquet table that Spark commits, names the file of the attempt that counts. A lost executor or a
speculative copy leaves at most a file that no index row names.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import released

MASK = 0xA282EAD8
_INDEX = "shard int, doc_id bigint, file string, offset bigint, length bigint, n_tokens bigint"
_RECORDS = "shard int, position bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_coders: dict = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def read_record(stream) -> bytes | None:
    """The next payload; None at the end. A record that is cut off or altered is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record: length")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("damaged record: payload")
    return body[:n]


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder:
    """Ids of whole texts, by the tokenizers library.

    The vocabulary lower-cases, and breaks at ASCII white space and between letters and punctuation before
    it merges. So the distinct words of a stretch of texts, found by Arrow, and the punctuation that ends
    them are encoded once and remembered, and a text is the concatenation of its words. Plain words go to
    the vocabulary's merges straight, others through all its steps. Texts that may hold special tokens are
    encoded as they are, and so is everything with ``whole``, for vocabularies without these properties.
    """

    #: Words longer than LONG bytes are not remembered; of the rest, LIMIT at most and the newest half at least,
    #: and ATOMS of their parts, so that what a worker remembers stays below 48 bytes * LIMIT + 300 bytes * ATOMS.
    LONG, LIMIT, ATOMS = 48, 400_000, 100_000
    #: ASCII punctuation, by which the vocabulary ends a word.
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Runs that the vocabulary doesn't cut further: letters of Latin scripts, in composed form, or punctuation.
    SIMPLE = re.compile(r"[a-zß-öø-ÿ]+|[!-/:-@\[-`{-~]+")
    #: Bytes of text taken at once.
    STRETCH = 4 << 20
    #: Of fewer distinct words than this, each is looked up by itself.
    FEW = 5_000

    def __init__(self, path: str, end_id: int, width: int, whole: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.code, self.whole, self.end_id = width, "<u2" if width == 2 else "<u4", whole, end_id
        self.letters = _byte_letters()
        self.atoms: dict[str, tuple[int, ...]] = {}
        self.words = pa.array([], pa.string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, self.code)

    def _ids(self, text: str) -> tuple[int, ...]:
        return tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _atom(self, atom: str) -> tuple[int, ...]:
        if self.SIMPLE.fullmatch(atom):
            shown = atom if atom.isascii() else atom.encode().decode("latin-1").translate(self.letters)
            return tuple(t.id for t in self.tokenizer.model.tokenize(shown))
        return self._ids(atom)

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.atoms.get(piece)
        if ids is None:
            ids = self._atom(piece)
            if len(piece) <= self.LONG:
                if len(self.atoms) >= self.ATOMS:
                    self.atoms.clear()
                self.atoms[piece] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        core = word.rstrip(self.MARKS)
        if core and len(core) < len(word) and (core[-1] in "0123456789" or core[-1].lower()[-1].isalpha()):
            return self._piece(core) + self._piece(word[len(core) :])
        return self._piece(word) if len(word) > len(core) else self._atom(word)

    def _learn(self, words: pa.Array, remember: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new words."""
        ids = [self._word(w) if w else () for w in words.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), self.code, int(sizes.sum()))
        if not remember:
            return sizes, flat
        short = np.asarray(pc.less_equal(pc.binary_length(words), self.LONG))
        if len(self.words) + len(words) > self.LIMIT:
            half = len(self.words) // 2
            self.words, self.flat, self.sizes = self.words.slice(half), self.flat[self.sizes[:half].sum() :], self.sizes[half:]
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short))])
        self.flat = np.concatenate([self.flat, flat[np.repeat(short, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes[short]])
        return sizes, flat

    def _stretch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        few = len(coded.dictionary) < self.FEW
        found = pa.nulls(len(coded.dictionary), pa.int32()) if few else pc.index_in(coded.dictionary, self.words)
        new, place = np.asarray(found.is_null()), np.asarray(found.fill_null(0))
        flat, sizes = self.flat, self.sizes
        starts = np.cumsum(sizes) - sizes
        n_of, at_of = (sizes[place], starts[place]) if len(sizes) else (np.zeros(len(place), np.int64), np.zeros(len(place), np.int64))
        if new.any():
            more, ids = self._learn(coded.dictionary.filter(pa.array(new)), not few)
            n_of[new], at_of[new] = more, np.cumsum(more) - more + len(flat)
            flat = np.concatenate([flat, ids])
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = n_of[at]
        stop = np.cumsum(n)
        tokens = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(at_of[at] - (stop - n), n)]
        ends = np.concatenate(([0], stop))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for i in range(len(texts)):
            yield tokens[ends[i] : ends[i + 1]]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text and the end id, as little-endian bytes, in order; null is the empty text."""
        texts = pc.fill_null(texts, "")
        apart = np.ones(len(texts), bool) if self.whole else pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        taken = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.STRETCH
        end = np.array([self.end_id], self.code).tobytes()
        edges = np.flatnonzero(np.diff(taken, prepend=-1)) if len(texts) else []
        for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
            part, alone = texts.slice(a, b - a), apart[a:b]
            rest = self._stretch(part.filter(pa.array(~alone)) if alone.any() else part)
            for i in range(b - a):
                ids = np.array(self._ids(part[i].as_py()), self.code) if alone[i] else next(rest)
                yield ids.tobytes() + end
            rest = ids = None
            released()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _wide(payload: bytes, width: int) -> bytes:
    """The same ids as 32-bit integers."""
    return payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def serialized(doc_id: int | None, ids: bytes) -> bytes:
    return struct.pack("<?q", doc_id is not None, doc_id or 0) + ids


def parsed(payload: bytes) -> tuple[int | None, bytes]:
    has, doc_id = struct.unpack_from("<?q", payload)
    return doc_id if has else None, payload[9:]


def token_width(tokenizer: str, end_id: int = 2) -> int:
    """Bytes that an id takes in the files."""
    return 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4


def write_records(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id",
    shards: int | None = None, whole: bool = False,
) -> DataFrame:
    """Writes every document as one record below ``path``; returns the index table (also at ``path/index``).

    Rows go to shards by ranges of ``doc_id`` and are sorted inside, so a shard needs only its own
    rows. Null texts are empty and get a record with the end id alone; null ids come first; repeated
    rows each get a record; other columns are not written. ``path`` is a folder that all executors
    reach. An empty table gives an empty index. Ids are whole numbers of 64 bits at most, as records have
    room for; other types are refused before anything is written.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"records hold whole numbers as ids, and {doc_id} is {kind.simpleString()}")
    width = token_width(tokenizer, end_id)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = tokenizer, end_id, width, whole
        coder = _coders.get(key) or _coders.setdefault(key, Coder(*key))
        shard = TaskContext.get().partitionId()
        name = f"{path}/shards/{shard:06d}-{uuid.uuid4().hex}.rec"
        stream, offset = None, 0
        try:
            for batch in batches:
                rows = []
                for row_id, ids in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1)), strict=True):
                    if stream is None:
                        fs, at = pyarrow.fs.FileSystem.from_uri(name)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        stream = fs.open_output_stream(at, buffer_size=1 << 20)
                    record = frame(serialized(row_id, ids))
                    stream.write(record)
                    rows.append((shard, row_id, name, offset, len(record), len(ids) // width))
                    offset += len(record)
                yield _batch(rows, _INDEX)
        finally:
            if stream is not None:
                stream.close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(write, _INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Of each record: shard, doc_id, file, its place and length in bytes, and its tokens."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, *, width: int = 2, ids: bool = True) -> DataFrame:
    """Every record as its file has it, checksums tested; ``start`` counts the ids of all records before it.

    A task streams one shard. ``ids`` are 32-bit little-endian integers, or null when not asked for;
    ``ids_crc32`` is their checksum. A file that disagrees with the index is an error. The driver
    holds one row a shard: its file, records and tokens.
    """
    files = read_index(spark, path).groupBy("shard", "file").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    todo, base = [], 0
    for r in sorted(files.collect(), key=lambda r: r["shard"]):
        todo.append((r["shard"], r["file"], r["n"], base))
        base += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, name, n, start in _rows(batches):
            fs, at = pyarrow.fs.FileSystem.from_uri(name)
            rows, held, position = [], 0, 0
            with fs.open_input_stream(at, buffer_size=1 << 20) as stream:
                while (payload := read_record(stream)) is not None:
                    doc_id, own = parsed(payload)
                    wide, tokens = _wide(own, width), len(own) // width
                    rows.append((shard, position, doc_id, start, tokens, zlib.crc32(wide), wide if ids else None))
                    position, start, held = position + 1, start + tokens, held + 64 + ids * len(wide)
                    if held > 8 << 20:
                        yield _batch(rows, _RECORDS)
                        rows, held = [], 0
            if position != n:
                raise ValueError(f"{name} has {position} records, its index {n}")
            yield _batch(rows, _RECORDS)

    dealt = spark.createDataFrame(todo, "shard int, file string, n bigint, start bigint")
    return (dealt.repartition(len(todo)) if todo else dealt).mapInArrow(read, _RECORDS)


def read_sequence(file: str, offset: int, length: int) -> tuple[int | None, bytes]:
    """One record by its index row, for shuffled reads: the document's id and its token ids as stored."""
    fs, at = pyarrow.fs.FileSystem.from_uri(file)
    with fs.open_input_file(at) as stream:
        stream.seek(offset)
        payload = read_record(pa.BufferReader(stream.read(length)))
    if payload is None:
        raise ValueError(f"no record at {offset} of {file}")
    return parsed(payload)
