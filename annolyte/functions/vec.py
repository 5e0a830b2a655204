"""Vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """With 1e-10 added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-10)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x: Column, target: Column, positive: float = 1.0, negative: float = 1.0) -> Column:
    """Weighted binary cross-entropy in its stable form."""
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    return positive * target * soft(-x) + negative * (1 - target) * soft(x)


def padded(a: Column, n: int, value) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(value), n)), 1, n)
