"""Vector scalar functions (H10, H11, B3) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    sq = F.transform(as_double(a), lambda x: x * x)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """Dot / (|a| |b|), capped at 1.0; null when a norm is zero."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, F.least(dot(a, b) / den, F.lit(1.0)))


def l2_normalize(a) -> Column:
    """Unit vector (null for the zero vector)."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n))


def valid_vector(a, dim: int) -> Column:
    """Exactly ``dim`` values and not all zero."""
    v = _c(a)
    return v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0)
