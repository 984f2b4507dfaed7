"""Vector functions as Catalyst expressions; components are summed in double, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, at most 1; 0 if one of them is zero."""
    product = dot(a, b)
    return F.least(F.coalesce(F.try_divide(product, norm(a) * norm(b)), product * 0.0), F.lit(1.0))


def normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def to_text(a: Column) -> Column:
    """A vector as JSON text, as exports carry it; from_text reads it."""
    return F.to_json(a)


def from_text(a: Column) -> Column:
    return F.from_json(a, "array<float>")
