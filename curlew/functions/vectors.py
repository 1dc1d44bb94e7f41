"""Vectors in array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, ColumnLike


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: ColumnLike) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def mean_pool(tokens: ColumnLike, mask: ColumnLike) -> Column:
    """Mean of the token vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(_c(tokens).alias("t"), _c(mask).alias("m")), lambda z: z["m"] == 1), lambda z: z["t"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.element_at(kept, 1), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def rounded(a: ColumnLike, digits: int = 2) -> Column:
    """Components rounded half to even: the key of bucket de-duplication."""
    return F.transform(_c(a), lambda x: F.bround(x.cast("double"), digits))
