"""Vectors as arrays: dot product, cosine, Matryoshka truncation. All maths in doubles, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length, or of nearly no norm."""
    size = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) >= TINY) & (norm(b) >= TINY)
    return F.when(fine, dot(a, b) / size).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.greatest(1 - cosine(a, b), F.lit(0.0))


def truncated(v: Column, width: int) -> Column:
    """The first ``width`` numbers, at length one; null if any isn't finite."""
    head = F.slice(_double(v), 1, width)
    finite = F.forall(head, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(head, lambda x: F.when(norm(head) >= TINY, x / norm(head)).otherwise(x)))
