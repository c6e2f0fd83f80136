"""Vector columns as arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of similarities that decide an order.
DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at unit length; a zero vector stays zero. The norm is bound once, not evaluated again for each number."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]


def usable(a: Column, dims: int = 64) -> Column:
    """Whether it has ``dims`` finite numbers, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dims) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def centroid_distance(q: Column, cur: Column, cand: Column) -> Column:
    """Distance from q to the centroid of the triangle (q, cur, cand): |cur + cand - 2q| / 3."""
    d = F.zip_with(F.zip_with(cur, cand, lambda x, y: x + y), q, lambda s, x: s - 2 * x)
    return norm(d) / 3.0
