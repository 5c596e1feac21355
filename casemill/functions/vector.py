"""Vector functions on array columns: sums in double precision, in generated code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; ``epsilon`` is added to the denominator. A zero vector without epsilon gives NaN."""
    below = norm(a) * norm(b) + F.lit(float(epsilon))
    return F.when(below == 0.0, F.lit(float("nan"))).otherwise(F.try_divide(inner_product(a, b), below))


def zero_vector(dim: int) -> Column:
    """The stand-in embedding where no model is available."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def safe_score(x: Column) -> Column:
    """Null, NaN and infinite scores become 0."""
    value = x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
