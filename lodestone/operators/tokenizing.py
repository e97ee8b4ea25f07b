"""Byte-pair and unigram tokenizers over text columns.

Training counts in Spark: distinct pieces with their frequencies are a table, a round's pair counts are one
aggregation over it, and a round takes all merges that can't touch one another. Encoding is a vectorised function whose merge ranks travel with it; the ids of
pieces are remembered, so that each is merged once in a worker.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import in_stretches
from lodestone.plans.lineage import cut_lineage, discard

# The published patterns that cut text before merging.
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GPT4_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
GPT2_SPECIALS = {"<|endoftext|>": 50256}
GPT4_SPECIALS = {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276}


#: Pieces of text whose ids a tokenizer remembers, and the longest of them.
_MEMORY, _SHORT = 50_000, 64


class _Remembered(dict):
    """Ids of pieces, found once each; emptied when full."""

    def __init__(self, find: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> list[int]:
        ids = self.find(piece)
        if len(piece) <= _SHORT:
            if len(self) >= _MEMORY:
                self.clear()
            self[piece] = ids
        return ids


@dataclass(frozen=True)
class BytePairs:
    """Merges in order of rank; id 256 + i is the i-th merge, ids below 256 are bytes."""

    merges: tuple[tuple[int, int], ...]
    pattern: str = GPT2_PATTERN
    specials: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ranks = {p: 256 + i for i, p in enumerate(self.merges)}
        found = _Remembered(lambda piece: _merged(list(piece.encode()), lambda a, b: ranks.get((a, b)), lambda a, b, rank: rank))
        object.__setattr__(self, "_pieces", found)

    def __reduce__(self):
        return BytePairs, (self.merges, self.pattern, self.specials)

    def vocabulary(self) -> dict[int, bytes]:
        out = {i: bytes([i]) for i in range(256)}
        for i, (a, b) in enumerate(self.merges):
            out[256 + i] = out[a] + out[b]
        return out | {i: s.encode() for s, i in self.specials.items()}

    def encode(self, text: str, allowed: str | frozenset[str] = "none_raise") -> list[int]:
        """Ids of a text. ``allowed`` special tokens: "all", "none", a set of some, or "none_raise" to refuse them."""
        if allowed == "none_raise" and any(s in text for s in self.specials):
            raise ValueError("the text holds a special token")
        known = self.specials if allowed == "all" else {} if isinstance(allowed, str) else {s: i for s, i in self.specials.items() if s in allowed}
        parts = regex.split(f"({'|'.join(map(regex.escape, known))})", text) if known else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(known[part])
            else:
                out += chain.from_iterable(self._pieces[piece] for piece in regex.findall(self.pattern, part))
        return out

    def piece(self, piece: str) -> list[int]:
        return self._pieces[piece]

    def decode(self, ids: Sequence[int]) -> str:
        return _decoded(self.vocabulary(), ids)


def _decoded(words: dict[int, bytes], ids: Sequence[int]) -> str:
    unknown = next((i for i in ids if i not in words), None)
    if unknown is not None:
        raise KeyError(f"no token {unknown}")
    return b"".join(words[i] for i in ids).decode("utf-8", "replace")


@dataclass(frozen=True)
class Ranks:
    """A published vocabulary: each token's bytes and its rank, which is its id; the pair whose token ranks lowest is merged first."""

    ranks: dict[bytes, int]
    pattern: str = GPT2_PATTERN

    def __post_init__(self) -> None:
        object.__setattr__(self, "_pieces", _Remembered(self._piece))

    def __reduce__(self):
        return Ranks, (self.ranks, self.pattern)

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        parts = _merged([data[i : i + 1] for i in range(len(data))], lambda a, b: self.ranks.get(a + b), lambda a, b, rank: a + b)
        return [self.ranks[x] for x in parts]

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which special tokens are ordinary text."""
        return list(chain.from_iterable(self._pieces[piece] for piece in regex.findall(self.pattern, text)))

    def piece(self, piece: str) -> list[int]:
        return self._pieces[piece]

    def decode(self, ids: Sequence[int]) -> str:
        return _decoded({rank: token for token, rank in self.ranks.items()}, ids)


@dataclass(frozen=True)
class Pieces:
    """A piece model: pieces with scores, by place; a space is written \u2581 and begins a word.

    ``merging`` models join the pair whose piece scores best, the others take the segmentation with the best
    sum. Characters in no piece become their bytes' pieces where the model has them, else ``unknown``.
    """

    scores: dict[str, float]
    ids: dict[str, int]
    merging: bool = False
    unknown: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "_words", _Remembered(self._word))
        object.__setattr__(self, "_longest", max(map(len, self.scores), default=1))

    def __reduce__(self):
        return Pieces, (self.scores, self.ids, self.merging, self.unknown)

    def _word(self, word: str) -> list[int]:
        parts = self.joined(word) if self.merging else self.best(word)
        return list(chain.from_iterable([self.ids[p]] if p in self.scores else self._bytes(p) for p in parts))

    def _bytes(self, part: str) -> list[int]:
        return [self.ids.get(f"<0x{b:02X}>", self.unknown) for b in part.encode()] if "<0x00>" in self.ids else [self.unknown]

    def joined(self, word: str) -> list[str]:
        return _merged(list(word), lambda a, b: None if a + b not in self.scores else -self.scores[a + b], lambda a, b, rank: a + b)

    def best(self, word: str) -> list[str]:
        """The segmentation with the best sum of scores; one character that is no piece costs ten below the worst."""
        worst = min(self.scores.values(), default=0.0) - 10.0
        sums, before = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self._longest), end):
                score = self.scores.get(word[start:end], worst if end - start == 1 else None)
                if score is not None and sums[start] + score > sums[end]:
                    sums[end], before[end] = sums[start] + score, start
        out, end = [], len(word)
        while end:
            out.append(word[before[end] : end])
            end = before[end]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; white space of any kind and length is one space."""
        return list(chain.from_iterable(self._words[f"\u2581{w}"] for w in text.split()))


def _merged(parts: list, rank_of: Callable, join: Callable) -> list:
    """Neighbours merged, lowest rank first and of equal ones the leftmost, until no pair has a rank.

    A queue holds the pairs and each part knows its neighbours, so a long piece takes n log n steps.
    """
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rank, i) for i in range(n - 1) if (rank := rank_of(parts[i], parts[i + 1])) is not None]
    heapify(queue)
    while queue:
        rank, i = heappop(queue)
        j = after[i]
        if parts[i] is None or j >= n or rank_of(parts[i], parts[j]) != rank:
            continue
        parts[i], parts[j] = join(parts[i], parts[j], rank), None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (new := rank_of(parts[left], parts[right])) is not None:
                heappush(queue, (new, left))
    return [p for p in parts if p is not None]


def _joined(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def _piece_table(docs: DataFrame, text: str, order: str | None, pattern: str) -> DataFrame:
    """Each distinct piece of two bytes or more once: ``n``, ``o`` and ``i``, where it was seen first, and ``ids``."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, lambda some: pa.array([regex.findall(pattern, t.as_py() or "") for t in some], pa.list_(pa.string())))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def byte_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, lambda some: pa.array([list(t.as_py().encode()) for t in some], pa.list_(pa.int32())))

    place = (F.col(order) if order else F.monotonically_increasing_id()).cast("bigint")
    pieces = docs.select(place.alias("o"), F.posexplode(cut(F.col(text))).alias("i", "piece")).where(F.octet_length("piece") > 1)
    table = pieces.groupBy("piece").agg(F.count("*").alias("n"), F.min(F.struct("o", "i")).alias("seen"))
    return table.select("n", "seen.o", "seen.i", byte_ids(F.col("piece")).alias("ids"))


def _with_merges(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    if len(ranks) == 1:
        (pair, new), = ranks.items()
        return _joined(ids, pair, new)
    return _merged(ids, lambda a, b: ranks.get((a, b)), lambda a, b, rank: rank)


def _pair_counter(ranks: dict[tuple[int, int], int]):
    """Pieces to pairs, after merges, summed up in each task: how often, and where first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(a, b, n, *seen) for (a, b), (n, seen) in sums.items()]
            sums.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "b", "n", "o", "i", "at"])

        for batch in batches:
            for n, o, i, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                ids = _with_merges(ids, ranks) if ranks else ids
                for at in range(len(ids) - 1):
                    one = sums.setdefault((ids[at], ids[at + 1]), [0, (o, i, at)])
                    one[0] += n
                    if (o, i, at) < one[1]:
                        one[1] = (o, i, at)
            if len(sums) > 500_000:
                yield out()
        if sums:
            yield out()

    return run


def apart(pairs: Sequence[tuple[int, int, int]], whole: bool, most: int) -> list[tuple[int, int]]:
    """The first of ``pairs`` (a, b, count), in order of training, that can be merged at once with the same result as one after the other.

    A merge of (a, b) changes counts of pairs that end in a or begin with b, and makes pairs that occur no more often than
    one of these did. So pairs are taken as long as none touches an earlier one and all that an earlier one can change
    or make stay rarer. ``whole`` tells that no pair is missing behind the last.
    """
    taken: list[tuple[int, int]] = []
    begins: set[int] = set()
    ends: set[int] = set()
    for place, (a, b, n) in enumerate(pairs[:most]):
        if taken:
            rivals = any(m == n and (y in begins or x in ends) for x, y, m in pairs[place + 1 :] if m == n)
            if a == b or a in ends or b in begins or rivals or (not whole and n == pairs[-1][2]):
                break
        taken.append((a, b))
        begins.add(a)
        ends.add(b)
        if a == b:
            break
    return taken


def train(
    docs: DataFrame, vocab_size: int, *, text: str = "text", order: str | None = None, pattern: str = GPT2_PATTERN, specials: dict[str, int] | None = None, listed: int = 500,
    rounds: int = 12,
) -> BytePairs:
    """Learns ``vocab_size - 256`` merges; each takes the commonest pair, of equal ones that seen first.

    The table holds each distinct piece once, with its frequency and the place where it was first seen
    (by ``order``, a whole number, else in no defined order). A job counts the pairs, summed up in the tasks, and gives the
    driver the ``listed`` commonest; all merges that can't touch one another (``apart``) are taken from one job. Merges are
    applied to the pieces as they are read, and the table is written anew every ``rounds`` jobs, so a lost executor costs no
    earlier one.
    """
    if vocab_size < 256:
        raise ValueError("a vocabulary has 256 bytes at least")
    table = cut_lineage(_piece_table(docs, text, order, pattern), "pieces")
    merges: list[tuple[int, int]] = []
    fresh: dict[tuple[int, int], int] = {}
    for job in count():
        if len(merges) == vocab_size - 256:
            break
        if fresh and job % rounds == 0:
            after = cut_lineage(table.mapInArrow(_merger(fresh), "n bigint, o bigint, i int, ids array<int>"), "pieces")
            discard(table)
            table, fresh = after, {}
        pairs = table.mapInArrow(_pair_counter(fresh), "a int, b int, n bigint, o bigint, i int, at int")
        sums = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("o", "i", "at")).alias("seen"))
        top = [(r["a"], r["b"], r["n"]) for r in sums.orderBy(F.desc("n"), "seen").limit(listed).collect()]
        if not top:
            break
        for pair in apart(top, len(top) < listed, vocab_size - 256 - len(merges)):
            fresh[pair] = 256 + len(merges)
            merges.append(pair)
    discard(table)
    return BytePairs(tuple(merges), pattern, specials or {})


def _merger(ranks: dict[tuple[int, int], int]):
    """Pieces after merges; those that have become one token are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_with_merges(x, ranks) for x in batch.column(3).to_pylist()]
            kept = pa.array([len(x) > 1 for x in ids])
            merged = pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(ids, pa.list_(pa.int32()))], ["n", "o", "i", "ids"])
            yield merged.filter(kept)

    return run


def encoder(tokenizer: BytePairs, allowed: str | frozenset[str] = "none"):
    """A vectorised function from text to ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, lambda some: pa.array([tokenizer.encode(t.as_py() or "", allowed) for t in some], pa.list_(pa.int32())))

    return encoded


def encode_distinct(docs: DataFrame, tokenizer: BytePairs | Ranks, *, text: str = "text", key: str = "id") -> DataFrame:
    """``key, ids`` of texts, each batch of them with its distinct pieces merged once; null texts have no ids.

    Pieces are numbered in the batch, the ids of each are found once and taken by number, so no list is made text by text.
    """

    def some(column: pa.Array) -> pa.Array:
        numbers: dict[str, int] = {}
        which, sizes = [], [0]
        for t in column.to_pylist():
            which += [numbers.setdefault(p, len(numbers)) for p in regex.findall(tokenizer.pattern, t or "")]
            sizes.append(len(which))
        ids = pa.array([tokenizer.piece(p) for p in numbers], pa.list_(pa.int32()))
        taken = ids.take(pa.array(which, pa.int32()))
        ends = np.append(0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends[np.array(sizes)].astype(np.int32)), taken.flatten())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, some)

    return docs.select(key, encoded(F.col(text)).alias("ids"))


def decoder(tokenizer: BytePairs | Ranks):
    """A vectorised function from ids to text; an unknown id fails."""

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        return pa.array([tokenizer.decode(row.as_py() or []) for row in ids], pa.string())

    return decoded


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``token`` (binary), ``rank`` of a rank file: lines of base64 and a number; other lines are skipped."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^[A-Za-z0-9+/]+=* \d+$"))
    return rows.select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def load_ranks(path: str, pattern: str = GPT2_PATTERN) -> Ranks:
    """A rank file as a tokenizer, which travels to the tasks."""
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a GPT-2 vocabulary: itself where it is one, else the next beyond 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def load_merges(spark: SparkSession, merges: str, ids: str, pattern: str = GPT2_PATTERN) -> Ranks:
    """A GPT-2 vocabulary of a file of merges and a JSON file of ids, read by Spark; an error where the two don't agree.

    Ids below 256 are bytes in the order of their printable characters, then one for each merge, then specials, which are left out.
    """
    named = _byte_names()
    lines = [r["value"] for r in spark.read.text(merges, wholetext=True).collect()][0].split("\n")
    pairs = [tuple(x.split(" ")) for x in lines if x.strip() and not x.startswith("#version")]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"a line of {merges} isn't a pair")
    bytes_of = lambda token: bytes(named[c] for c in token)
    ranks = {bytes([b]): i for i, b in enumerate(named.values())}
    for left, right in pairs:
        if bytes_of(left) not in ranks or bytes_of(right) not in ranks:
            raise ValueError(f"{left} {right} merges what isn't there yet")
        ranks[bytes_of(left) + bytes_of(right)] = len(ranks)
    found = json.loads(spark.read.text(ids, wholetext=True).first()["value"])
    plain = {bytes_of(t): i for t, i in found.items() if not (t.startswith("<|") and t.endswith("|>"))}
    if plain != ranks:
        raise ValueError(f"{merges} and {ids} differ in {len(set(plain.items()) ^ set(ranks.items()))} tokens")
    return Ranks(ranks, pattern)


def load_pieces(path: str) -> Pieces:
    """A piece model file as a tokenizer; the scores of merging models are whole numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = {model.id_to_piece(i): model.get_score(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return Pieces(plain, {model.id_to_piece(i): i for i in every}, all(s == int(s) for s in plain.values()), model.unk_id())


def _encoder_of(encode: Callable[[str], list[int]]):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, lambda some: pa.array([encode(t.as_py() or "") for t in some], pa.list_(pa.int32())))

    return encoded


def rank_encoder(path: str, pattern: str = GPT2_PATTERN):
    """A vectorised function to ids of a published rank file; specials are ordinary text."""
    return _encoder_of(load_ranks(path, pattern).encode)


def unigram_encoder(path: str, *, first: int | None = None, last: int | None = None, most: int | None = None):
    """A vectorised function to ids of a piece model, framed by ``first`` and ``last`` and cut to ``most``."""
    tokenizer = load_pieces(path)
    head, tail = [x for x in (first,) if x is not None], [x for x in (last,) if x is not None]

    def framed(text: str) -> list[int]:
        ids = tokenizer.encode(text)
        return head + (ids[: max(most - len(head) - len(tail), 0)] if most else ids) + tail

    return _encoder_of(framed)
