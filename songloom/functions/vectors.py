"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalise(vector: Column) -> Column:
    """Vector divided by its length; a zero vector is returned as it is."""
    length = norm(vector)
    divisor = F.when(length == 0.0, F.lit(1.0)).otherwise(length)
    return F.transform(as_double(vector), lambda x: x / divisor)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of vectors of any length, 0 when one of them is zero."""
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(left, right) / lengths)
