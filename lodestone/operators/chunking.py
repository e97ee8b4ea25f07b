"""Chunks of bounded length with overlap.

Cutting is sequential inside one text, so it runs as a vectorised function over texts; all around it,
numbering, metadata and writing, is DataFrame work. Lengths are code points, or tokens by a tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import in_stretches

Length = Callable[[str], int]
#: From large units to small; the empty one splits into grapheme clusters.
SEPARATORS = ("\n\n", "\n", " ", "")
#: In place of what joins pieces: a piece that stays as it is.
_WHOLE = "\0whole"

# Keywords that begin a unit of code, by language. A separator is a line end, the keyword and a space.
_KEYWORDS = {
    "cpp": ("class", "void", "int", "float", "double", "if", "for", "while", "switch", "case"),
    "go": ("func", "var", "const", "type", "if", "for", "switch", "case"),
    "java": ("class", "public", "protected", "private", "static", "if", "for", "while", "switch", "case"),
    "kotlin": ("class", "public", "protected", "private", "internal", "companion", "fun", "val", "var", "if", "for", "while", "when", "case", "else"),
    "js": ("function", "const", "let", "var", "class", "if", "for", "while", "switch", "case", "default"),
    "ts": ("enum", "interface", "namespace", "type", "class", "function", "const", "let", "var", "if", "for", "while", "switch", "case", "default"),
    "php": ("function", "class", "if", "foreach", "while", "do", "switch", "case"),
    "proto": ("message", "service", "enum", "option", "import", "syntax"),
    "python": ("class", "def"),
    "ruby": ("def", "class", "if", "unless", "while", "for", "do", "begin", "rescue"),
    "rust": ("fn", "const", "let", "if", "while", "for", "loop", "match", "const"),
    "scala": ("class", "object", "def", "val", "var", "if", "for", "while", "match", "case"),
    "swift": ("func", "class", "struct", "enum", "if", "for", "while", "do", "switch", "case"),
    "csharp": (
        "interface", "enum", "implements", "delegate", "event", "class", "abstract", "public", "protected", "private", "static", "return",
        "if", "continue", "for", "foreach", "while", "switch", "break", "case", "else", "try", "throw", "finally", "catch",
    ),
    "sol": (
        "pragma", "using", "contract", "interface", "library", "constructor", "type", "function", "event", "modifier", "error", "struct",
        "enum", "if", "for", "while", "do while", "assembly",
    ),
}
# The separators of markup languages; those of rst and markdown are patterns.
_RST = ("\n=+\n", "\n-+\n", "\n\\*+\n", "\n\n.. *\n\n")
_MARKDOWN = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n")
_LATEX_SECTIONS = ("chapter", "section", "subsection", "subsubsection")
_LATEX_ENVIRONMENTS = ("enumerate", "itemize", "description", "list", "quote", "quotation", "verse", "verbatim", "align")
_HTML_TAGS = (
    "body", "div", "p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "span", "table", "tr", "td", "th", "ul", "ol",
    "header", "footer", "nav", "head", "style", "script", "meta", "title",
)
_COBOL_DIVISIONS = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")
_COBOL_SECTIONS = ("WORKING-STORAGE", "LINKAGE", "FILE", "INPUT-OUTPUT")
_COBOL_VERBS = ("OPEN", "CLOSE", "READ", "WRITE", "IF", "ELSE", "MOVE", "PERFORM", "UNTIL", "VARYING", "ACCEPT", "DISPLAY")

LANGUAGES = (*_KEYWORDS, "rst", "markdown", "latex", "html", "cobol")


def language_separators(language: str) -> tuple[str, ...]:
    """Separators for a programming or markup language; those of rst and markdown are patterns."""
    name = language.lower()
    if name == "python":
        return (*(f"\n{w} " for w in _KEYWORDS[name]), "\n\tdef ", *SEPARATORS)
    if name in _KEYWORDS:
        return (*(f"\n{w} " for w in _KEYWORDS[name]), *SEPARATORS)
    if name == "rst":
        return (*_RST, *SEPARATORS)
    if name == "markdown":
        return (*_MARKDOWN, *SEPARATORS)
    if name == "latex":
        return (*(f"\n\\{s}{{" for s in _LATEX_SECTIONS), *(f"\n\\begin{{{e}}}" for e in _LATEX_ENVIRONMENTS), "$$", "$", " ", "")
    if name == "html":
        return (*(f"<{t}" for t in _HTML_TAGS), "")
    if name == "cobol":
        return (
            *(f"\n{d} DIVISION." for d in _COBOL_DIVISIONS), *(f"\n{s} SECTION." for s in _COBOL_SECTIONS), *(f"\n{v} " for v in _COBOL_VERBS),
            "\nSTOP RUN.", "\n", " ", "",
        )
    raise ValueError(f"no separators for {language}")


def cut(text: str, pattern: str, keep: bool) -> list[str]:
    """``text`` cut at a pattern; kept separators begin the piece that follows. The empty pattern cuts between grapheme clusters."""
    if not pattern:
        return list(text) if text.isascii() and "\r\n" not in text else regex.findall(r"\X", text)
    if not keep:
        return [p for p in re.split(pattern, text) if p]
    starts = [0, *(m.start() for m in re.finditer(pattern, text) if m.end() > m.start()), len(text)]
    return [text[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]


def packed(pieces: Sequence[str], joint: str, size: int, overlap: int, length: Length = len, strip: bool = True) -> list[str]:
    """Consecutive pieces joined into chunks of at most ``size``, each repeating up to ``overlap`` of the last.

    A piece longer than ``size`` makes a chunk of its own. With sums of lengths up to each piece, the length
    of any stretch of pieces is a difference, and a chunk is a stretch whose two ends move forward.
    """
    gap = length(joint)
    upto = [0, *accumulate(length(p) + gap for p in pieces)]
    joined = lambda a, b: max(upto[b] - upto[a] - gap, 0)
    spans, first = [], 0
    for i in range(1, len(pieces)):
        if joined(first, i + 1) > size:
            spans.append((first, i))
            while first < i and (joined(first, i) > overlap or joined(first, i + 1) > size):
                first += 1
    if pieces:
        spans.append((first, len(pieces)))
    chunks = (joint.join(pieces[a:b]) for a, b in spans)
    return [c for c in (c.strip() if strip else c for c in chunks) if c]


@dataclass(frozen=True)
class CharacterSplitter:
    """Cuts at one separator and packs the pieces."""

    size: int = 4000
    overlap: int = 200
    separator: str = "\n\n"
    strip: bool = True
    length: Length = len

    def split(self, text: str) -> list[str]:
        return packed(cut(text, re.escape(self.separator), False), self.separator, self.size, self.overlap, self.length, self.strip)


@dataclass(frozen=True)
class RecursiveSplitter:
    """Cuts at the first separator that the text holds, and pieces that are too long at the later ones.

    With ``patterns`` the separators are regular expressions.
    """

    size: int = 4000
    overlap: int = 0
    separators: Sequence[str] = SEPARATORS
    keep: bool = True
    strip: bool = True
    patterns: bool = False
    length: Length = len

    def split(self, text: str) -> list[str]:
        """Stretches of text still to cut, the next one on top, each with the separators left for it."""
        out: list[str] = []
        todo: list[tuple[list[str], str, Sequence[str]]] = [([text], "", self.separators)]
        while todo:
            pieces, joint, left = todo.pop()
            if not left:
                out += packed(pieces, joint, self.size, self.overlap, self.length, self.strip) if joint is not _WHOLE else pieces
                continue
            separator, later = self._first(pieces[0], left)
            parts = []
            for short, run in groupby(cut(pieces[0], separator if self.patterns else re.escape(separator), self.keep), lambda p: self.length(p) < self.size):
                if short:
                    parts.append((list(run), "" if self.keep else separator, ()))
                else:
                    parts += [([p], _WHOLE, later if separator else ()) for p in run]
            todo += reversed(parts)
        return out

    def _first(self, text: str, separators: Sequence[str]) -> tuple[str, Sequence[str]]:
        """The first separator that the text holds, or the last one, and those after it."""
        for i, s in enumerate(separators):
            if not s or i + 1 == len(separators) or (re.search(s, text) if self.patterns else s in text):
                return s, separators[i + 1 :]
        raise ValueError("no separators")


Splitter = CharacterSplitter | RecursiveSplitter
_CHUNK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def first_places(data: bytes, parts: list[bytes]) -> list[int]:
    """Where each part stands first, -1 if nowhere.

    In a long text all stretches of 16 bytes are hashed at once, and parts are looked for only where their first one may stand, so the
    time doesn't grow with the number of parts times the length.
    """
    if len(data) < 1 << 16 or not parts:
        return [data.find(p) for p in parts]
    x, factor = np.frombuffer(data, np.uint8).astype(np.uint64), 0x9E3779B97F4A7C15
    for step in (1, 2, 4, 8):
        x = x[:-step] * np.uint64(factor) + x[step:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF

    def head(p: bytes) -> int:
        n, f = np.frombuffer(p[:16], np.uint8).astype(np.uint64), 0x9E3779B97F4A7C15
        for step in (1, 2, 4, 8):
            n = n[:-step] * np.uint64(f) + n[step:]
            f = f * f & 0xFFFFFFFFFFFFFFFF
        return int(n[0])

    heads = {p: head(p) for p in set(parts) if len(p) >= 16}
    at = np.flatnonzero(np.isin(x, np.fromiter(set(heads.values()), np.uint64, len(set(heads.values())))))
    places: dict[int, list[int]] = {}
    for i, h in zip(at.tolist(), x[at].tolist(), strict=True):
        places.setdefault(h, []).append(i)
    found = {p: next((i for i in places.get(heads[p], ()) if data.startswith(p, i)), -1) if p in heads else data.find(p) for p in set(parts)}
    return [found[p] for p in parts]


def chunks_of(splitter: Splitter):
    """A vectorised function: text to chunks with UTF-8 byte offsets of their first occurrence, -1 if trimming moved it."""

    def some(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            whole = t.as_py() or ""
            parts = splitter.split(whole)
            out.append([{"text": c, "start": start, "stop": start + len(c.encode())} for c, start in zip(parts, first_places(whole.encode(), [c.encode() for c in parts]), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))

    @F.arrow_udf(_CHUNK)
    def chunked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_stretches(batches, some)

    return chunked


def split_documents(docs: DataFrame, splitter: Splitter, *, text: str = "text", key: str = "id", keep_parent: bool = True) -> DataFrame:
    """A row for each chunk: a derived id, the text, the document's other columns, and where the chunk stands.

    ``parent_doc_id`` (with ``keep_parent``), ``page_no`` from 1, ``start_index`` and ``end_index`` replace
    columns of these names. Ids are hashes of parent and number, so a rerun gives the same ones.
    """
    chunk = docs.select("*", F.posexplode(chunks_of(splitter)(F.col(text))).alias("_at", "_c"))
    own = {"parent_doc_id": F.col(key).cast("string")} if keep_parent else {}
    own |= {"page_no": F.col("_at") + 1, "start_index": F.col("_c.start"), "end_index": F.col("_c.stop")}
    others = [c for c in docs.columns if c not in (key, text, *own)]
    ident = F.sha2(F.concat_ws("/", F.col(key).cast("string"), (F.col("_at") + 1).cast("string")).cast("binary"), 256)
    return chunk.select(ident.alias("id"), F.col("_c.text").alias("text"), *others, *(c.alias(n) for n, c in own.items()))


def fixed_chunks(docs: DataFrame, size: int, *, text: str = "text", key: str = "id") -> DataFrame:
    """``key, page_no, text``: consecutive stretches of ``size`` code points, trimmed, empty ones dropped; no Python."""
    stretches = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    parts = F.filter(F.transform(stretches, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda c: c != "")
    return docs.select(key, F.posexplode(parts).alias("_at", "text")).select(key, (F.col("_at") + 1).alias("page_no"), "text")
