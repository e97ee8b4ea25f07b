"""Text, hash, codec, time and JSON functions as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters of Western European languages and the letters they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
SPACE = r"^\s+|\s+$"


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, SPACE, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def or_default(text: Column, default: str) -> Column:
    return F.when(is_blank(text), F.lit(default)).otherwise(text)


def snake_case(text: Column) -> Column:
    """``camelCase`` as ``camel_case``."""
    return F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", "_"))


def found_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str = r"\s+") -> Column:
    """Split by a pattern, without empty pieces."""
    return F.filter(F.split(text, pattern), lambda x: x != "")


def formatted(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column, null as nothing; an unknown name is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise KeyError(f"no value for {', '.join(sorted(missing))}")
    columns = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*columns)


def digest(text: Column, kind: str = "sha256") -> Column:
    """md5, sha1 or sha256 as lower-case hex."""
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256)}[kind](text.cast("binary"))


def to_base64(text: Column) -> Column:
    return F.base64(text.cast("binary"))


def from_base64(text: Column) -> Column:
    return F.unbase64(text).cast("string")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n)


def snowflake(millis: Column, datacenter: int, worker: int, sequence: Column) -> Column:
    """A 64-bit id of time, place and sequence, ascending with time. The epoch is a fixed value."""
    epoch = 1534832906275
    return F.shiftleft(millis - epoch, 22).bitwiseOR(F.lit(datacenter << 17 | worker << 12)).bitwiseOR(sequence)


def regex_escaped(text: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def url_parts(url: Column) -> Column:
    """scheme, host, port (null where none is given), path and query of a URL as a struct; null where it isn't one."""
    part = lambda group: F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$", group)
    port = F.when(part(3) != "", part(3).cast("int"))
    return F.when(part(1) != "", F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), port.alias("port"), part(4).alias("path"), part(5).alias("query")))


def url_of(scheme: Column, host: Column, path: Column, port: Column | None = None, query: Column | None = None) -> Column:
    """The URL of its parts; a null port, path or query is left out."""
    at = F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")) if port is not None else F.lit("")
    asked = F.coalesce(F.when(query != "", F.concat(F.lit("?"), query)), F.lit("")) if query is not None else F.lit("")
    return F.concat(scheme, F.lit("://"), host, at, F.coalesce(path, F.lit("")), asked)


def query_string(**values: Column) -> Column:
    """``a=1&b=2`` of columns in the order given, encoded; nulls are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in values.items()]
    return F.array_join(F.filter(F.array(*pairs), lambda x: x.isNotNull()), "&")


def combined(texts: Column) -> Column:
    """Each text and a line end, in order."""
    return F.concat(F.array_join(texts, "\n"), F.when(F.size(texts) > 0, F.lit("\n")).otherwise(F.lit("")))


def combined_messages(messages: Column) -> Column:
    """``role: content`` lines of an array of structs."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def uuid() -> Column:
    """A random UUID for each row; store it before it is read twice."""
    return F.uuid()


def random_integer(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    if low > high:
        raise ValueError(f"{low} is above {high}")
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint")


def random_text(length: int, letters: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", seed: int | None = None) -> Column:
    """``length`` letters, each drawn alone."""
    draw = lambda i: F.substring(F.lit(letters), F.floor(F.rand(None if seed is None else seed + i) * len(letters)).cast("int") + 1, 1)
    return F.concat(*(draw(i) for i in range(length))) if length else F.lit("")


def sql_quoted(text: Column) -> Column:
    """A text as an SQL literal: quotes doubled, between quotes."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


_ARITHMETIC = re.compile(r"^[\d\s.+\-*/%^(),a-z_]*$")
_MATHS = frozenset("abs ceil floor sqrt exp ln log10 pow sin cos tan round least greatest".split())


def _operand(text: str, step: int) -> str:
    """The number, bracket or call that ``text`` ends with (step -1) or begins with (1), white space at that side included."""
    bare = text.rstrip() if step < 0 else text.lstrip()
    gap, depth, size = len(text) - len(bare), 0, 0
    opens, closes = (")", "(") if step < 0 else ("(", ")")
    if step > 0 and bare[:1] in ("-", "+"):
        size = 1
    while size < len(bare):
        c = bare[size] if step > 0 else bare[-1 - size]
        if c == closes and not depth:
            break
        if not depth and not (c.isalnum() or c in "._" or c == opens):
            break
        depth += (c == opens) - (c == closes)
        size += 1
    size += gap
    return text[:size] if step > 0 else text[len(text) - size :]


def arithmetic(expression: str) -> Column:
    """A column for an arithmetic expression of numbers, ``+ - * / % ^ **`` and a few functions; anything else is refused."""
    text = expression.lower().strip()
    if not text or not _ARITHMETIC.match(text) or set(re.findall(r"[a-z_]+", text)) - _MATHS:
        raise ValueError(f"not an arithmetic expression: {expression!r}")
    text = text.replace("**", "^")
    while "^" in text:  # the last power first, so that powers bind to the right
        at = text.rindex("^")
        left, right = _operand(text[:at], -1), _operand(text[at + 1 :], 1)
        if not left.strip() or not right.strip():
            raise ValueError(f"can't read the power in {expression!r}")
        text = f"{text[: at - len(left)]}pow({left}, {right}){text[at + 1 + len(right) :]}"
    return F.expr(re.sub(r"(?<![\w.])(\d+)(?![\w.])", r"\1.0D", text))


def in_stretches(batches: Iterator[pa.Array], make: Callable[[pa.Array], pa.Array], most: int = 1 << 20) -> Iterator[pa.Array]:
    """``make`` of Arrow columns, for each stretch of about ``most`` bytes of text: what is made of one stretch alone is held at once."""
    for column in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        starts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist()] if len(column) else []
        for a, b in zip(starts, [*starts[1:], len(column)], strict=True) if starts else ():
            yield make(column[a:b])
        pa.default_memory_pool().release_unused()
