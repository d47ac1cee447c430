"""Vector arithmetic on arrays, in double precision and in the array's order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm; null for a zero vector. The norm is computed once, not for each place."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def valid(a: Column, dims: int) -> Column:
    """Of the right length, finite, and not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & (F.size(a) == dims) & finite & (norm(a) > 0)
