"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """Divided by the norm, or by 1e-12 if that is larger."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def rescaled(cosine) -> Column:
    """A cosine as a score from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(cosine) + 1) / 2))
