"""Rules that a single reading must meet, and the plausible range of each column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import c, present

# Plausible range and unit of each column.
RANGES = {
    "PM2.5": (0, 500, "μg/m³"),
    "PM10": (0, 600, "μg/m³"),
    "NO2": (0, 200, "μg/m³"),
    "SO2": (0, 1000, "μg/m³"),
    "CO": (0, 50000, "μg/m³"),
    "O3": (0, 300, "μg/m³"),
    "temperature": (-50, 60, "°C"),
    "humidity": (0, 100, "%"),
    "pressure": (800, 1200, "hPa"),
    "wind_speed": (0, 100, "m/s"),
    "wind_direction": (0, 360, "degrees"),
}

# Bounds of a valid single reading (None = open).
READING_RULES = {
    "PM2.5": (0, None),
    "PM10": (0, None),
    "NO2": (0, None),
    "SO2": (0, None),
    "CO": (0, None),
    "O3": (0, None),
    "temperature": (-50, 60),
    "humidity": (0, 100),
}


def broken(col: Column, low: float | None, high: float | None) -> Column:
    """True when a non-null value is outside the bounds."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (col < low)
    if high is not None:
        bad = bad | (col > high)
    return F.coalesce(bad, F.lit(False))


def with_violations(
    df: DataFrame, rules: Mapping[str, tuple] = READING_RULES, name: str = "violations"
) -> DataFrame:
    """Add the names of the columns whose rule a row breaks (empty array: a good row)."""
    flags = [F.when(broken(c(n), *rules[n]), F.lit(n)) for n in present(df, rules)]
    return df.withColumn(name, F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"))


def split_by_rules(
    df: DataFrame, rules: Mapping[str, tuple] = READING_RULES
) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with the broken rules)."""
    marked = with_violations(df, rules)
    return (
        marked.where(F.size("violations") == 0).drop("violations"),
        marked.where(F.size("violations") > 0),
    )
