"""Feature columns for readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import c, present
from ..functions import calendar, indices
from ..sources.readings import POLLUTANTS
from .order import AUTO, Layout, over_rows
from .windows import lags

# Default model features, besides every column with "_lag_" in its name.
DEFAULT_FEATURES = [
    "hour", "dayofweek", "month",
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction",
    "PM_ratio", "NO2_SO2_ratio",
    "temp_humidity_interaction", "wind_temp_interaction",
    "hour_sin", "hour_cos", "dayofweek_sin", "dayofweek_cos",
]


def row_features(df: DataFrame, ts: str = "datetime", pi: float | None = None) -> dict[str, Column]:
    """Features that need only their own row; those whose inputs are missing are left out."""
    stamp = c(ts)
    out = calendar.parts(stamp)
    out |= calendar.cyclical(out["hour"], out["dayofweek"], pi)
    have = set(df.columns)
    if have.issuperset(indices.COMPOSITE_WEIGHTS):
        out["AQI"] = indices.weighted_index()
    for name, top, bottom in (("PM_ratio", "PM2.5", "PM10"), ("NO2_SO2_ratio", "NO2", "SO2")):
        if {top, bottom} <= have:
            out[name] = indices.ratio(top, bottom)
    for name, left, right in (
        ("temp_humidity_interaction", "temperature", "humidity"),
        ("wind_temp_interaction", "wind_speed", "temperature"),
    ):
        if {left, right} <= have:
            out[name] = indices.interaction(left, right)
    return out


def add_features(
    df: DataFrame,
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    lagged: Sequence[str] = tuple(POLLUTANTS[:3]),
    steps: Sequence[int] = (1, 24),
    rolling: int = 24,
    pi: float | None = None,
    layout: Layout = AUTO,
) -> DataFrame:
    """Calendar, cyclical, index, ratio, interaction, lag and rolling-mean columns at once.

    Everything row-relative shares one window, so there is one shuffle; the row-local columns are
    added after it and never travel.
    """
    known = present(df, lagged)

    def add(w) -> dict[str, Column]:
        frame = w.rowsBetween(-(rolling - 1), 0)
        out = {f"{v}_lag_{k}h": F.lag(c(v), k).over(w) for v in known for k in steps}
        return out | {f"{v}_rolling_{rolling}h": F.avg(c(v)).over(frame) for v in known}

    if known:
        df = over_rows(
            df, add, keys=keys, order=[ts, *tie], before=max(*steps, rolling - 1), layout=layout
        )
    return df.withColumns(row_features(df, ts, pi))


def add_light_features(
    df: DataFrame,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    backfill: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """The short feature set: calendar, weekend flag, rounded index, one lag per value."""
    known = present(df, values)
    if known:
        df = lags(
            df, known, [1], keys=keys, order=[ts, *tie], name=lambda v, k: f"{v}_lag{k}",
            backfill=backfill, layout=layout,
        )
    stamp = c(ts)
    out = {"hour": F.hour(stamp), "month": F.month(stamp)} | calendar.iso_parts(stamp)
    if set(indices.COMPOSITE_WEIGHTS) <= set(df.columns):
        out["AQI"] = indices.weighted_index(round_to=2)
    return df.withColumns(out)


def feature_list(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """Model features the frame has: the given or default ones, then every lag column."""
    if wanted is not None:
        return present(df, wanted)
    return present(df, DEFAULT_FEATURES) + [n for n in df.columns if "_lag_" in n]


def add_air_quality(df: DataFrame) -> DataFrame:
    """Sub-indices, the overall index, its level, health impact and advice for every row."""
    names = present(df, indices.SEGMENTS)
    df = df.withColumns({f"{n}_index": indices.sub_index(n) for n in names})
    df = df.withColumn("index", indices.overall_index(*[c(f"{n}_index") for n in names]))
    worst = F.col("index")
    return df.withColumns(
        {
            "level": indices.level(worst),
            "health_impact": indices.health_impact(worst),
            "recommendation": indices.recommendation(worst),
            "alert": indices.alert(worst),
        }
    )
