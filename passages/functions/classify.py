"""Probabilities to labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passages.config import OTHER_LABEL
from passages.functions.vectors import bind


def softmax(logits: Column) -> Column:
    """exp(x - max) over its sum, so that large logits do not overflow."""
    powers = bind(
        bind(logits.cast("array<double>"), lambda xs: F.struct(xs.alias("xs"), F.array_max(xs).alias("top"))),
        lambda s: F.transform(s["xs"], lambda x: F.exp(x - s["top"])),
    )
    with_total = bind(
        powers,
        lambda ps: F.struct(
            ps.alias("ps"), F.aggregate(ps, F.lit(0.0), lambda total, x: total + x).alias("total")
        ),
    )
    return bind(with_total, lambda s: F.transform(s["ps"], lambda x: x / s["total"]))


def decode(index: Column, classes: Column) -> Column:
    """0-based class index to its label."""
    return F.element_at(classes, index + 1)


def threshold_label(
    probabilities: Column, classes: Column, threshold: float, other: str = OTHER_LABEL
) -> Column:
    """Label of the first largest probability if it reaches the threshold."""
    best = F.array_max(probabilities)
    index = F.array_position(probabilities, best).cast("int") - 1
    return F.when(best >= threshold, decode(index, classes)).otherwise(F.lit(other))
