"""Calendar parts, cyclical encodings, day, month and season names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season.
SEASONS = {
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "fall": (9, 10, 11),
    "winter": (12, 1, 2),
}


def parts(ts: Column) -> dict[str, Column]:
    """hour, dayofweek (1 = Sunday), month and year."""
    return {
        "hour": F.hour(ts),
        "dayofweek": F.dayofweek(ts),
        "month": F.month(ts),
        "year": F.year(ts),
    }


def iso_parts(ts: Column) -> dict[str, Column]:
    """day_of_week (0 = Monday) and the 0/1 weekend flag."""
    day = F.weekday(ts)
    return {"day_of_week": day, "is_weekend": day.isin(5, 6).cast("int")}


def cyclical(hour: Column, dayofweek: Column, pi: float | None = None) -> dict[str, Column]:
    """Sine and cosine of the hour of day and the day of week; ``pi`` overrides the constant."""
    half_turn = F.pi() if pi is None else F.lit(float(pi))
    out = {}
    for name, part, period in (("hour", hour, 24), ("dayofweek", dayofweek, 7)):
        angle = part * 2 * half_turn / period
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def month_name(ts: Column, short: bool = False) -> Column:
    return F.date_format(ts, "MMM" if short else "MMMM")


def day_name_of(dayofweek: Column) -> Column:
    """Full English name of Spark's day number (1 = Sunday)."""
    return day_name(F.date_add(F.lit("2023-01-01").cast("date"), dayofweek - 1))


def month_name_of(month: Column, short: bool = False) -> Column:
    return month_name(F.make_date(F.lit(2023), month, F.lit(1)), short)


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def is_weekend_day(dayofweek: Column) -> Column:
    return dayofweek.isin(1, 7)
