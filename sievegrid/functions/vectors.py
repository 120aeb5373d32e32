"""Arithmetic on ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, which counts as eps at least and is worked out once."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """max(1 - a.b, 0) of unit vectors, to 12 digits so that equal vectors tie in any order of summation."""
    return F.round(F.greatest(1 - dot(a, b), F.lit(0.0)), 12)


def noisy(v: Column, scale: float, seed: int | None = None) -> Column:
    """v plus Gaussian noise of variance `scale` per element, as a unit vector again; 0 leaves v as it is."""
    if scale < 0:
        raise ValueError("scale must not be negative")
    if scale == 0:
        return v
    # Box-Muller on two hashes of (seed, place, value): a draw per element, the same on every run
    draw = lambda x, i, k: (F.pmod(F.xxhash64(F.lit(seed or 0), F.lit(k), i, x), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda x, i: F.sqrt(-2 * F.log(draw(x, i, 1))) * F.cos(6.283185307179586 * draw(x, i, 2))
    return unit(F.transform(v, lambda x, i: x + scale**0.5 * normal(x, i)))
