"""English stems by the suffix rules of Porter's algorithm (1980)."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The algorithm's suffixes and what replaces them, in the order they are tried.
_SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    out: list[str] = []
    for i, letter in enumerate(word):
        out.append("v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last one no w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules, least: int) -> str:
    """By the first rule whose suffix the word has, where enough stands before it."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) >= least else word
    return word


def _inflections(word: str) -> str:
    """Plurals, past tenses, gerunds, final y."""
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix):
                if "v" in _shape(stem):
                    doubled = stem[-2:-1] == stem[-1:] and _shape(stem)[-1:] == "c" and stem[-1] not in "lsz"
                    restored = stem.endswith(("at", "bl", "iz")) or (_measure(stem) == 1 and _short_end(stem))
                    word = stem[:-1] if doubled and not stem.endswith(("at", "bl", "iz")) else stem + "e" if restored else stem
                break
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    word = _inflections(word)
    word = _replaced(word, sorted(_SECOND, key=lambda r: -len(r[0])), 1)
    word = _replaced(word, _THIRD, 1)
    suffix = next((x for x in sorted(_FOURTH, key=len, reverse=True) if word.endswith(x)), None)
    if suffix:
        left = word[: -len(suffix)]
        if _measure(left) > 1 and (suffix != "ion" or left[-1:] in ("s", "t")):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short_end(left)):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(words: Column) -> Column:
    """The stems of an array of words."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stemmed(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        found = pa.array([stem(w) if w is not None else None for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        offsets = lists.offsets if not lists.offset else pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
        return pa.ListArray.from_arrays(offsets, found)

    return stemmed(words)
