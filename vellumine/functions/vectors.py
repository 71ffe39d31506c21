"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as of length 1e-10, so its cosine is 0."""
    size = lambda v: F.greatest(norm(v), F.lit(1e-10))
    return dot(a, b) / (size(a) * size(b))


def unit(a: Column) -> Column:
    """a of length 1, so that cosines are one dot product at query time."""
    n = F.greatest(norm(a), F.lit(1e-10))
    return F.transform(a, lambda x: x.cast("double") / n)
