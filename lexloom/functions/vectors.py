"""Column expressions over ``ARRAY<FLOAT>`` vectors; all arithmetic in doubles."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: 0 when the lengths differ or a vector is empty, null for a zero vector."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits, F.try_divide(dot(a, b), norm(a) * norm(b))).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(
        vectors, first,
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def vector_by_length(v: Column, length: int) -> Column:
    """The vector when it has that length: one column per embedding model."""
    return F.when(F.size(v) == length, v)


def from_json_vector(text: Column) -> Column:
    """A vector stored as a JSON string."""
    return F.from_json(text, "array<double>")
