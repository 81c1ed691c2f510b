"""Aggregate expressions that Spark does not have in the wanted form, and labels for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are non-null; NULL for a constant side.

    Spark's ``corr`` raises on a constant column under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness (G1); NULL under three values or for a constant."""
    n = F.count(x).cast("double")
    g1 = F.when(F.stddev_pop(x) > 0, F.skewness(x))
    return F.when(n >= 3, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1)


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis (G2); NULL under four values or for a constant."""
    n = F.count(x).cast("double")
    g2 = F.when(F.stddev_pop(x) > 0, F.kurtosis(x))
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def strength(r: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of |r|: the first ``(threshold, label)`` it exceeds, thresholds falling."""
    out = F.when(r.isNull(), F.lit(None).cast("string"))
    for threshold, label in steps:
        out = out.when(F.abs(r) > threshold, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def direction(r: Column, up: str = "positive", down: str = "negative") -> Column:
    return F.when(r.isNotNull(), F.when(r > 0, F.lit(up)).otherwise(F.lit(down)))
