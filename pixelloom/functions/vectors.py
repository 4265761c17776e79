"""Vector expressions on ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> Column:
    """Dot product in double precision."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)")


def l2_normalised(v: str) -> Column:
    norm = f"sqrt(aggregate({v}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    return F.expr(f"transform(array({norm}), n -> transform({v}, x -> try_divide(cast(x as double), n)))[0]")


def multi_hot(labels: str, classes: int) -> Column:
    return F.expr(f"transform(sequence(0, {classes - 1}), i -> if(array_contains({labels}, i), 1D, 0D))")
