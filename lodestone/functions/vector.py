"""Vector arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if a vector has no length."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score(distance: Column) -> Column:
    """1 minus the distance, between 0 and 1; 0 for a distance that is no finite number."""
    odd = distance.isNull() | F.isnan(distance) | (F.abs(distance) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)))
