"""Vector arithmetic on array columns, in doubles and from left to right.

Three cosine distances are kept apart: they differ in zero vectors and in clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_or_one(a: Column, b: Column) -> Column:
    """For search: a zero vector is at distance 1; not clamped."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / F.nullif(both, F.lit(0.0)))


def cosine_or_null(a: Column, b: Column) -> Column:
    """For grouping: a zero vector has no distance; the similarity is clamped to [-1, 1]."""
    return cosine_with_norms(a, b, norm(a), norm(b))


def cosine_with_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """The same, of vectors whose norms are known: in joins they are taken once a row, not once a pair."""
    both = F.nullif(norm_a * norm_b, F.lit(0.0))
    return F.when(both.isNotNull(), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / both)))


def cosine_of_units(a: Column, b: Column) -> Column:
    """For faces: both have length one; clamped to [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )


def normalized(a: Column) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def present(a: Column) -> Column:
    """A vector of zeros counts as none."""
    return F.when(F.forall(a, lambda x: x == 0), F.lit(None)).otherwise(a)
