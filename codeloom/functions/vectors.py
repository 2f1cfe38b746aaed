"""Vector columns on ARRAY<FLOAT|DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

NORM_FLOOR = 1e-12


def _as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_as_doubles(left), _as_doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit length; the norm is floored so that a zero vector stays zero."""
    norm = F.greatest(l2_norm(vector), F.lit(NORM_FLOOR))
    return bind(norm, lambda n: F.transform(_as_doubles(vector), lambda x: x / n))


def cosine(left: Column, right: Column) -> Column:
    floor = F.lit(NORM_FLOOR)
    return dot(left, right) / (F.greatest(l2_norm(left), floor) * F.greatest(l2_norm(right), floor))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""
    powers = bind(F.array_max(_as_doubles(logits)), lambda top: F.transform(_as_doubles(logits), lambda x: F.exp(x - top)))
    return bind(
        powers,
        lambda p: bind(
            F.aggregate(p, F.lit(0.0), lambda total, x: total + x), lambda total: F.transform(p, lambda x: x / total)
        ),
    )
