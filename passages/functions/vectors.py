"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclid")
SCORE_DIGITS = 6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """Length one; a zero vector stays zero."""
    return bind(
        F.struct(as_doubles(vector).alias("v"), norm(vector).alias("length")),
        lambda s: F.transform(s["v"], lambda x: F.coalesce(F.try_divide(x, s["length"]), F.lit(0.0))),
    )


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity (cosine, dot) or distance (euclid), rounded so that ties are ties."""
    check_metric(metric)
    if metric == "euclid":
        squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
        value = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    elif metric == "dot":
        value = dot(a, b)
    else:
        value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.round(value, SCORE_DIGITS)


def best_first(score_column: Column, metric: str) -> Column:
    return score_column.asc() if metric == "euclid" else score_column.desc()
