"""Vector functions on arrays of numbers; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.text import let


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def unit(v: Column) -> Column:
    """The vector at length one; the zero vector stays as it is."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def softmax(v: Column) -> Column:
    powers = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One layer: each output is the product with a row of weights plus its bias."""
    rows = [dot(v, F.array(*map(F.lit, row))) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def sum_by_position(v: Column, dim: int) -> list[Column]:
    """Aggregates that sum a vector column position by position."""
    return [F.sum(F.get(v, i).cast("double")) for i in range(dim)]
