"""Codecs and similarity kernels as column expressions, with NumPy twins for a literal query.

Kernels compare encoded values: INT8 codes or packed bytes, not decoded vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DimensionMismatch, InvalidConfig


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def valid(v: Column, dimensions: int) -> Column:
    """The vector has the right length and only finite values."""
    bad = F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimensions) & ~bad, F.lit(False))


def f32_encode(v: Column) -> Column:
    return F.struct(doubles(v).alias("data"))


def int8_encode(v: Column) -> Column:
    """Codes -128..127 over the vector's own range; a constant vector has codes 0."""
    v = doubles(v)
    low, high = F.array_min(v), F.array_max(v)
    code = lambda x: F.when(high == low, F.lit(0)).otherwise((F.floor((x - low) / (high - low) * 255 + 0.5) - 128).cast("int"))
    return F.struct(F.transform(v, code).alias("data"), low.alias("min"), high.alias("max"))


def int8_decode(q: Column) -> Column:
    span = q["max"] - q["min"]
    return F.transform(q["data"], lambda c: F.when(span == 0, q["min"]).otherwise((c + 128) / F.lit(255.0) * span + q["min"]))


def bit_encode(v: Column, dimensions: int) -> Column:
    """Sign bits, highest first, zero-padded bytes; zero counts as positive."""
    v = doubles(v)
    byte = lambda b: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)),
        F.lit(0),
        lambda a, i: a + F.when((b * 8 + i < dimensions) & (F.get(v, b * 8 + i) >= 0), F.element_at(F.array(*(F.lit(128 >> k) for k in range(8))), i + 1)).otherwise(0),
    )
    return F.struct(F.transform(F.sequence(F.lit(0), F.lit((dimensions + 7) // 8 - 1)), byte).alias("data"), F.lit(dimensions).alias("dimensions"))


def bit_decode(q: Column, dimensions: int, zero: float = -1.0) -> Column:
    """+1 for set bits, and -1 (or the viewer's 0) for the others."""
    bit = lambda i: F.get(q["data"], F.floor(i / 8).cast("int")).bitwiseAND(F.element_at(F.array(*(F.lit(128 >> k) for k in range(8))), (i % 8) + 1))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(bit(i) != 0, F.lit(1.0)).otherwise(F.lit(zero)))


def encode(v: Column, quantization: str, dimensions: int) -> Column:
    return {"F32": f32_encode, "INT8": int8_encode, "BIT": lambda x: bit_encode(x, dimensions)}[quantization](v)


def decode(q: Column, quantization: str, dimensions: int) -> Column:
    return {"F32": lambda x: x["data"], "INT8": int8_decode, "BIT": lambda x: bit_decode(x, dimensions)}[quantization](q)


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a side has no length."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def hamming(a: Column, b: Column, dimensions: int) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: 8 - F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (same - (8 * ((dimensions + 7) // 8) - dimensions)) / F.lit(float(dimensions))


def similarity(a: Column, b: Column, metric: str, dimensions: int) -> Column:
    if metric == "hamming":
        return hamming(a, b, dimensions)
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean}[metric](a, b)


def encode_query(vector: list[float], quantization: str, dimensions: int) -> list:
    """The codes of a query, encoded by its own range, as the columns are."""
    v = np.asarray(vector, np.float64)
    if v.shape != (dimensions,):
        raise DimensionMismatch(dimensions, v.size)
    if not np.isfinite(v).all():
        raise InvalidConfig("vector values must be finite numbers")
    if quantization == "F32":
        return v.tolist()
    if quantization == "INT8":
        span = v.max() - v.min()
        return [0] * dimensions if span == 0 else (np.floor((v - v.min()) / span * 255 + 0.5).astype(int) - 128).tolist()
    return np.packbits(v >= 0).astype(int).tolist()


def l2_normalize(v: Column) -> Column:
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))
