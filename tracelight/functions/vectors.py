"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def centred(a: Column) -> Column:
    mean = total(F.transform(a, lambda x: x.cast("double"))) / F.size(a)
    return F.transform(a, lambda x: x.cast("double") - mean)


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation; 0 for different lengths or a constant vector."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(cosine(centred(a), centred(b)))


def mean_squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / F.size(a)


def bits_match(a: Column, b: Column, width: int) -> Column:
    """How many of the low ``width`` bits of two integers agree."""
    return F.lit(width) - F.bit_count(a.bitwiseXOR(b))
