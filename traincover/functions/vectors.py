"""Vector expressions. They stay in the JVM, for narrow inputs; bulk products run in `operators.topk`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length; an all-zero vector stays zero."""
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    length = F.greatest(F.sqrt(squares), F.lit(EPSILON))
    return F.transform(vector, lambda x: x.cast("double") / length)


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
