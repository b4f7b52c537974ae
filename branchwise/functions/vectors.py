"""Dense vectors held as ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def vector_sum(array: Column, dim: int, weight: Column | None = None) -> Column:
    """Element-wise sum over rows as an array, NULL if there is no vector.

    One plain sum per element: these run as hash aggregates with a map-side part and fixed-size
    buffers, unlike object-based aggregates, which sort once there are more than a few groups.
    """
    def element(i: int) -> Column:
        x = array[i].cast("double")
        return F.sum(x if weight is None else x * weight)
    return F.when(F.count(array) > 0, F.array(*[element(i) for i in range(dim)]))


def scale(array: Column, by: Column) -> Column:
    return F.transform(array, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where either side is missing or has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
