"""Vector arithmetic on array columns, in double precision.

All are expressions that stay in the JVM. ``cosine_to`` is a vectorised alternative for a fixed query
and large dimensions: one matrix product for each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null where a vector is null or zero, or where lengths differ. Norms may be given."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def l2_normalized(a: Column, epsilon: float = 1e-6) -> Column:
    """``a`` over the root of its squared length plus ``epsilon``."""
    length = F.sqrt(dot(a, a) + epsilon)
    return F.element_at(F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def cosine_to(query: Sequence[float]):
    """A vectorised function of a vector column: its cosine with ``query``, as ``cosine``."""
    q = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(q @ q))

    @F.arrow_udf(T.DoubleType())
    def similar(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        sizes = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()])
        fit = np.flatnonzero(sizes == len(q))
        if len(fit) and length > 0:
            flat = vectors.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), len(q))
            norms = np.sqrt((flat * flat).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fit] = np.where(norms > 0, flat @ q / (norms * length), np.nan)
        return pa.array(out, pa.float64(), from_pandas=True)

    return similar


def letter_counts():
    """A vectorised function of a text column: how often each letter a to z stands in it, in either case, as doubles; null of a null text."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counted(text: pa.Array) -> pa.Array:
        out = np.zeros((len(text), 26))
        for i, t in enumerate(text):
            if t.is_valid and len(t.as_buffer()):
                n = np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=123)
                out[i] = n[65:91] + n[97:123]
        ends = pa.array(np.arange(len(text) + 1, dtype=np.int32) * 26)
        return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)), mask=text.is_null())

    return counted
