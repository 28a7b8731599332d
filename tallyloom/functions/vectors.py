"""Vectors, bits and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 if a vector is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)


def sign_bits(vector: Column, bits: int = 32, first: int = 1) -> Column:
    """A number with one bit for the sign of each of ``bits`` components."""
    part = F.slice(vector, first, bits)
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; 64 if either isn't one."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    fine = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    bits = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    return F.when(F.coalesce(fine, F.lit(False)), bits).otherwise(64)


def converted(amount: Column, rate: Column, unknown: str = "null") -> Column:
    """An amount by a rate, to the cent. An unknown rate gives null, or counts as 1 where unknown is "one"."""
    return F.round(amount * (F.coalesce(rate, F.lit(1)) if unknown == "one" else rate), 2)


def inverse_rate(rate: Column) -> Column:
    return F.when(rate > 0, F.round(1 / rate, 6))


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
