"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.array_size(a) == F.array_size(b)) & (F.array_size(a) > 0)
    return F.when(fit & (norm > 0), dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)
