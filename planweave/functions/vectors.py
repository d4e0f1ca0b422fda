"""Vector arithmetic on arrays of doubles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    """Length of the vector; 0 for an empty one."""
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length; 0 for an empty vector."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for an empty vector, other lengths or a length of zero."""
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    n = norm(a) * norm(b)
    return F.when(fits & (n > 0), dot(a, b) / n).otherwise(0.0)
