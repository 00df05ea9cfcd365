"""Vector arithmetic on ARRAY<FLOAT> columns, accumulated in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("ip", "l2", "cosine")


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def distance(a: Column, b: Column, metric: str) -> Column:
    """ip: the inner product itself, a similarity. l2: squared. cosine: 1 - cosine, 1 for a zero vector."""
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return F.lit(1.0) - F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def ranking(distance_: Column, metric: str) -> Column:
    """Sort by this for the nearest first."""
    return F.desc(distance_) if metric == "ip" else F.asc(distance_)
