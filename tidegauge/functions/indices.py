"""Composite and breakpoint indices as plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import c

# Weights of the composite index.
COMPOSITE_WEIGHTS = {"PM2.5": 0.4, "PM10": 0.3, "NO2": 0.2, "SO2": 0.1}

# Fixed values: (upper bound, index at the start, index span, concentration at the start,
# concentration span) of each linear segment; above the last bound the index is CAP.
SEGMENTS = {
    "PM2.5": [
        (12.0, 0.0, 50.0, 0.0, 12.0),
        (35.4, 51.0, 49.0, 12.1, 35.4 - 12.1),
        (55.4, 101.0, 49.0, 35.5, 55.4 - 35.5),
    ],
    "PM10": [
        (54.0, 0.0, 50.0, 0.0, 54.0),
        (154.0, 51.0, 49.0, 55.0, 99.0),
        (254.0, 101.0, 49.0, 155.0, 99.0),
    ],
    "NO2": [
        (53.0, 0.0, 50.0, 0.0, 53.0),
        (100.0, 51.0, 49.0, 54.0, 46.0),
        (360.0, 101.0, 49.0, 101.0, 259.0),
    ],
}
CAP = 200.0

# Upper bound, level, health impact, recommendation; the last row has no bound.
LEVELS = [
    (50, "Good", "Air quality is satisfactory", "Enjoy outdoor activities"),
    (
        100,
        "Moderate",
        "Acceptable for most people",
        "Unusually sensitive people should reduce prolonged outdoor exertion",
    ),
    (
        150,
        "Unhealthy for Sensitive Groups",
        "Sensitive groups may experience health effects",
        "Sensitive groups should reduce prolonged outdoor exertion",
    ),
    (
        None,
        "Unhealthy",
        "Everyone may experience health effects",
        "Everyone should avoid prolonged outdoor exertion",
    ),
]


def weighted_index(weights: Mapping[str, float] = COMPOSITE_WEIGHTS, round_to: int | None = None) -> Column:
    """Weighted sum of columns; NULL if any of them is NULL. Rounds half-way cases to even."""
    total = reduce(lambda a, b: a + b, [c(n) * F.lit(w) for n, w in weights.items()])
    if round_to is None:
        return total
    unit = float(10**round_to)
    return F.rint(total * unit) / unit


def ratio(top: str, bottom: str, offset: float = 0.001) -> Column:
    return F.try_divide(c(top), c(bottom) + F.lit(offset))


def interaction(left: str, right: str) -> Column:
    return c(left) * c(right)


def piecewise_index(value: Column, segments: Sequence[tuple], cap: float = CAP) -> Column:
    """Linear interpolation in the first segment whose bound is not exceeded, else ``cap``."""
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for bound, start, span, origin, width in segments:
        out = out.when(value <= bound, F.lit(span / width) * (value - F.lit(origin)) + F.lit(start))
    return out.otherwise(F.lit(cap))


def sub_index(name: str) -> Column:
    return piecewise_index(c(name), SEGMENTS[name])


def overall_index(*subs: Column) -> Column:
    """The worst sub-index; NULLs are skipped."""
    return F.greatest(*subs) if len(subs) > 1 else subs[0]


def _graded(index: Column, field: int) -> Column:
    out = F.when(index.isNull(), F.lit(None).cast("string"))
    for row in LEVELS[:-1]:
        out = out.when(index <= row[0], F.lit(row[field]))
    return out.otherwise(F.lit(LEVELS[-1][field]))


def level(index: Column) -> Column:
    return _graded(index, 1)


def health_impact(index: Column) -> Column:
    return _graded(index, 2)


def recommendation(index: Column) -> Column:
    return _graded(index, 3)


def alert(index: Column, warning: float = 100, critical: float = 150) -> Column:
    """``alert`` above ``critical``, ``warning`` above ``warning``, else ``ok``."""
    return (
        F.when(index.isNull(), F.lit(None).cast("string"))
        .when(index > critical, F.lit("alert"))
        .when(index > warning, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
