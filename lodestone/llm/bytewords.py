"""Words of many texts at once, found as bytes: every separator here is one ASCII byte, so UTF-8 needs no decoding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A to Z become a to z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def inside(outside: bytes) -> np.ndarray:
    """By byte: whether it belongs to words, which the bytes of ``outside`` separate."""
    out = np.ones(256, bool)
    out[list(outside)] = False
    return out


#: Words end at white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACED = inside(b" \t\n\x0b\x0c\r")
#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
TERMS = inside(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words(NamedTuple):
    """Words in order, their texts' numbers, and where each begins and ends in ``data``, the folded bytes."""

    words: pa.Array
    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray


def parts(text: pa.Array, most: int = 16 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive rows with ``most`` bytes together, or of one longer text; nulls are empty."""
    text = pc.fill_null(text, "")
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], width, len(text) + 1, text.offset * np.dtype(width).itemsize) if len(text) else np.zeros(1, width)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, text.slice(at, to - at)
        at = to


def words_in(text: pa.Array, of_word: np.ndarray) -> Words:
    """All words of texts without nulls, A-Z folded, cut at the bytes that ``of_word`` doesn't hold."""
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], width, len(text) + 1, text.offset * np.dtype(width).itemsize).astype(np.int64)
    whole = text.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and offsets[-1] else np.zeros(0, np.uint8)
    data, offsets = LOWER[data], offsets - offsets[0]
    word = of_word[data]
    edges = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    edges[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edges[:-1]))
    stop = np.flatnonzero(word & (~after | edges[1:])) + 1
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=ends[1:])
    kept = np.ascontiguousarray(data[word])
    kind, narrow = (pa.large_string(), np.int64) if len(kept) >= 1 << 31 else (pa.string(), np.int32)
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(narrow)), pa.py_buffer(kept)])
    return Words(words, np.searchsorted(offsets, start, "right") - 1, start, stop, data)


def spaced(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space between, and where each begins and ends there."""
    length = w.stop - w.start
    stop = np.cumsum(length + 1) - 1
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    letters = np.frombuffer(w.words.buffers()[2], np.uint8) if len(length) else np.zeros(0, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(length)), length)] = letters
    return out.tobytes(), stop - length, stop
