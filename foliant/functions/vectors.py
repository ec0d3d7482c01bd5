"""Vector arithmetic on ARRAY<FLOAT> columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal(values: Sequence[float]) -> Column:
    """A query vector as a constant array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector or different lengths."""
    size = norm(a) * norm(b)
    return 1 - F.when(size > 0, dot(a, b) / size)


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def text_literal(a: Column) -> Column:
    """[x,y,...] with eight decimals, rounded as C's printf does: by the exact value, a tie to the even digit.

    A float times 10^8 is exact in double precision, so it is rounded there; from 10^7 on floats have no ninth decimal."""
    even = lambda x: F.when(F.abs(x) < 1e7, F.rint(x * 1e8) / 1e8).otherwise(x)
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.8f", even(x.cast("double")))), ","), F.lit("]"))


def rounded(x: Column, places: int) -> Column:
    """Rounded half up; what rounds to zero keeps its sign, as in C and SQL engines built on it."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)
