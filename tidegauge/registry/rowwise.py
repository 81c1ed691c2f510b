"""Features and labels that need one row only, and the whole feature set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import c
from ..functions import calendar, indices, rules
from ..operators.features import (
    DEFAULT_FEATURES,
    add_air_quality,
    add_features,
    add_light_features,
    feature_list,
)
from ..operators.select import latest_row
from .base import query


@query("calendar_parts", """
    SELECT event_id, hour(ts) AS hour, dayofweek(ts) + 1 AS dayofweek, month(ts) AS month, year(ts) AS year
    FROM events
    """)  # fmt: skip
def _(t):
    return t.events.select("event_id", *[e.alias(n) for n, e in calendar.parts(c("ts")).items()])


@query("weekend_flags", """
    SELECT event_id, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend
    FROM events
    """)  # fmt: skip
def _(t):
    return t.events.select("event_id", *[e.alias(n) for n, e in calendar.iso_parts(c("ts")).items()])


@query("cyclical_encoding", """
    SELECT event_id,
           sin(hour(ts) * 2 * pi() / 24) AS hour_sin, cos(hour(ts) * 2 * pi() / 24) AS hour_cos,
           sin((dayofweek(ts) + 1) * 2 * pi() / 7) AS dayofweek_sin,
           cos((dayofweek(ts) + 1) * 2 * pi() / 7) AS dayofweek_cos
    FROM events
    """, doubles="hour_sin hour_cos dayofweek_sin dayofweek_cos")  # fmt: skip
def _(t):
    p = calendar.parts(c("ts"))
    cols = calendar.cyclical(p["hour"], p["dayofweek"])
    return t.events.select("event_id", *[e.alias(n) for n, e in cols.items()])


@query("composite_index", """
    SELECT datetime, "PM2.5" * 0.4::DOUBLE + PM10 * 0.3::DOUBLE + NO2 * 0.2::DOUBLE + SO2 * 0.1::DOUBLE AS idx
    FROM readings
    """, views="readings", doubles="idx")  # fmt: skip
def _(t):
    return t.readings.select("datetime", indices.weighted_index().alias("idx"))


@query("ratios", """
    SELECT datetime, "PM2.5" / (PM10 + 0.001::DOUBLE) AS pm_ratio, NO2 / (SO2 + 0.001::DOUBLE) AS no2_so2_ratio
    FROM readings
    """, views="readings", doubles="pm_ratio no2_so2_ratio")  # fmt: skip
def _(t):
    return t.readings.select(
        "datetime",
        indices.ratio("PM2.5", "PM10").alias("pm_ratio"),
        indices.ratio("NO2", "SO2").alias("no2_so2_ratio"),
    )


@query("interactions", """
    SELECT datetime, temperature * humidity AS temp_humidity, wind_speed * temperature AS wind_temp FROM readings
    """, views="readings", doubles="temp_humidity wind_temp")  # fmt: skip
def _(t):
    return t.readings.select(
        "datetime",
        indices.interaction("temperature", "humidity").alias("temp_humidity"),
        indices.interaction("wind_speed", "temperature").alias("wind_temp"),
    )


@query("calendar_names", """
    SELECT o_orderkey, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name,
           strftime(o_orderdate, '%b') AS month_short
    FROM orders
    """)  # fmt: skip
def _(t):
    ts = c("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        calendar.day_name(ts).alias("day_name"),
        calendar.month_name(ts).alias("month_name"),
        calendar.month_name(ts, short=True).alias("month_short"),
    )


@query("seasons", """
    SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
                            WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer'
                            WHEN month(o_orderdate) IN (9, 10, 11) THEN 'fall' ELSE 'winter' END AS season
    FROM orders
    """)  # fmt: skip
def _(t):
    return t.orders.select("o_orderkey", calendar.season(F.month("o_orderdate")).alias("season"))


_SUB = """
    CASE WHEN "PM2.5" IS NULL THEN NULL
         WHEN "PM2.5" <= 12 THEN 50.0::DOUBLE / 12 * "PM2.5"
         WHEN "PM2.5" <= 35.4::DOUBLE THEN 49.0::DOUBLE / (35.4::DOUBLE - 12.1::DOUBLE) * ("PM2.5" - 12.1::DOUBLE) + 51
         WHEN "PM2.5" <= 55.4::DOUBLE THEN 49.0::DOUBLE / (55.4::DOUBLE - 35.5::DOUBLE) * ("PM2.5" - 35.5::DOUBLE) + 101
         ELSE 200 END AS "PM2.5_index",
    CASE WHEN PM10 IS NULL THEN NULL
         WHEN PM10 <= 54 THEN 50.0::DOUBLE / 54 * PM10
         WHEN PM10 <= 154 THEN 49.0::DOUBLE / 99 * (PM10 - 55) + 51
         WHEN PM10 <= 254 THEN 49.0::DOUBLE / 99 * (PM10 - 155) + 101
         ELSE 200 END AS "PM10_index",
    CASE WHEN NO2 IS NULL THEN NULL
         WHEN NO2 <= 53 THEN 50.0::DOUBLE / 53 * NO2
         WHEN NO2 <= 100 THEN 49.0::DOUBLE / 46 * (NO2 - 54) + 51
         WHEN NO2 <= 360 THEN 49.0::DOUBLE / 259 * (NO2 - 101) + 101
         ELSE 200 END AS "NO2_index"
    """
_GRADES = """
    CASE WHEN idx IS NULL THEN NULL WHEN idx <= 50 THEN 'Good' WHEN idx <= 100 THEN 'Moderate'
         WHEN idx <= 150 THEN 'Unhealthy for Sensitive Groups' ELSE 'Unhealthy' END AS level,
    CASE WHEN idx IS NULL THEN NULL WHEN idx <= 50 THEN 'Air quality is satisfactory'
         WHEN idx <= 100 THEN 'Acceptable for most people'
         WHEN idx <= 150 THEN 'Sensitive groups may experience health effects'
         ELSE 'Everyone may experience health effects' END AS health_impact,
    CASE WHEN idx IS NULL THEN NULL WHEN idx <= 50 THEN 'Enjoy outdoor activities'
         WHEN idx <= 100 THEN 'Unusually sensitive people should reduce prolonged outdoor exertion'
         WHEN idx <= 150 THEN 'Sensitive groups should reduce prolonged outdoor exertion'
         ELSE 'Everyone should avoid prolonged outdoor exertion' END AS recommendation,
    CASE WHEN idx IS NULL THEN NULL WHEN idx > 150 THEN 'alert' WHEN idx > 100 THEN 'warning'
         ELSE 'ok' END AS alert
    """
_QUALITY_COLUMNS = ["PM2.5_index", "PM10_index", "NO2_index", "index"]


def _air(rows):
    names = [*_QUALITY_COLUMNS, "level", "health_impact", "recommendation", "alert"]
    return add_air_quality(rows).select("datetime", *[c(n) for n in names])


_AIR_SQL = f"""
    WITH s AS (SELECT datetime, {_SUB} FROM readings),
    o AS (SELECT *, greatest("PM2.5_index", "PM10_index", "NO2_index") AS idx FROM s)
    SELECT datetime, "PM2.5_index", "PM10_index", "NO2_index", idx AS "index", {_GRADES} FROM o
    """


@query("air_quality", _AIR_SQL, views="readings", doubles=" ".join(_QUALITY_COLUMNS))
def _(t):
    return _air(t.readings)


@query(
    "air_quality_now",
    _AIR_SQL + " ORDER BY datetime DESC LIMIT 1",
    views="readings",
    doubles=" ".join(_QUALITY_COLUMNS),
)
def _(t):
    return _air(latest_row(t.readings, order=["datetime"]))


@query("alerts", f"""
    WITH s AS (SELECT datetime, {_SUB} FROM readings),
    o AS (SELECT datetime, greatest("PM2.5_index", "PM10_index", "NO2_index") AS idx FROM s)
    SELECT datetime, CASE WHEN idx > 150 THEN 'alert' ELSE 'warning' END AS alert FROM o WHERE idx > 100
    """, views="readings")  # fmt: skip
def _(t):
    rows = add_air_quality(t.readings).where(F.col("alert") != "ok")
    return rows.select("datetime", "alert")


_RULES = {"PM2.5": (40, None), "PM10": (0, None), "NO2": (0, 52), "humidity": (0, None)}


@query("rule_violations", """
    SELECT datetime, array_to_string(list_filter([
        CASE WHEN "PM2.5" < 40 THEN 'PM2.5' END, CASE WHEN PM10 < 0 THEN 'PM10' END,
        CASE WHEN NO2 < 0 OR NO2 > 52 THEN 'NO2' END, CASE WHEN humidity < 0 THEN 'humidity' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM readings
    """, views="readings")  # fmt: skip
def _(t):
    rows = rules.with_violations(t.readings, _RULES)
    return rows.select("datetime", F.array_join("violations", ",").alias("violations"))


@query("good_rows", """
    SELECT datetime FROM readings
    WHERE NOT coalesce("PM2.5" < 40, false) AND NOT coalesce(NO2 > 52, false)
    """, views="readings")  # fmt: skip
def _(t):
    good, _ = rules.split_by_rules(t.readings, _RULES)
    return good.select("datetime")


_LAGGED = ["PM2.5", "PM10", "NO2"]
_ROW_RELATIVE = ", ".join(
    f'lag("{v}", 1) OVER w AS "{v}_lag_1h", lag("{v}", 24) OVER w AS "{v}_lag_24h", '
    f'avg("{v}") OVER (ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS "{v}_rolling_24h"'
    for v in _LAGGED
)
FEATURES_SQL = f"""
    hour(datetime) AS hour, dayofweek(datetime) + 1 AS dayofweek, month(datetime) AS month,
    year(datetime) AS year,
    sin(hour(datetime) * 2 * pi() / 24) AS hour_sin, cos(hour(datetime) * 2 * pi() / 24) AS hour_cos,
    sin((dayofweek(datetime) + 1) * 2 * pi() / 7) AS dayofweek_sin,
    cos((dayofweek(datetime) + 1) * 2 * pi() / 7) AS dayofweek_cos,
    "PM2.5" * 0.4::DOUBLE + PM10 * 0.3::DOUBLE + NO2 * 0.2::DOUBLE + SO2 * 0.1::DOUBLE AS "AQI",
    "PM2.5" / (PM10 + 0.001::DOUBLE) AS "PM_ratio", NO2 / (SO2 + 0.001::DOUBLE) AS "NO2_SO2_ratio",
    temperature * humidity AS temp_humidity_interaction, wind_speed * temperature AS wind_temp_interaction,
    {_ROW_RELATIVE}
    """
_FEATURE_DOUBLES = " ".join(
    [
        "PM2.5 PM10 NO2 SO2 CO O3 temperature humidity pressure wind_speed wind_direction",
        "hour_sin hour_cos dayofweek_sin dayofweek_cos AQI PM_ratio NO2_SO2_ratio",
        "temp_humidity_interaction wind_temp_interaction",
        *[f"{v}_{s}" for v in _LAGGED for s in ("lag_1h", "lag_24h", "rolling_24h")],
    ]
)


@query(
    "feature_set",
    f"SELECT *, {FEATURES_SQL} FROM readings WINDOW w AS (ORDER BY datetime)",
    views="readings",
    doubles=_FEATURE_DOUBLES,
)
def _(t):
    return add_features(t.readings)


@query("light_features", """
    SELECT datetime, "PM2.5", hour(datetime) AS hour, month(datetime) AS month,
           isodow(datetime) - 1 AS day_of_week, CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend,
           round_even(("PM2.5" * 0.4::DOUBLE + PM10 * 0.3::DOUBLE + NO2 * 0.2::DOUBLE + SO2 * 0.1::DOUBLE) * 100, 0) / 100 AS "AQI",
           coalesce(lag("PM2.5") OVER (ORDER BY datetime),
                    CASE WHEN row_number() OVER (ORDER BY datetime) = 1 THEN "PM2.5" END) AS "PM2.5_lag1"
    FROM readings
    """, views="readings", doubles="PM2.5 AQI PM2.5_lag1")  # fmt: skip
def _(t):
    rows = add_light_features(t.readings, backfill=True)
    names = ["datetime", "PM2.5", "hour", "month", "day_of_week", "is_weekend", "AQI", "PM2.5_lag1"]
    return rows.select(*[c(n) for n in names])


JOB_FEATURES = [*DEFAULT_FEATURES, *[f"{v}_lag_{k}h" for v in _LAGGED for k in (1, 24)]]


@query("feature_names", f"""
    WITH names AS (SELECT unnest({JOB_FEATURES}) AS feature)
    SELECT feature, (SELECT count(*) FROM readings) AS rows FROM names
    """, views="readings")  # fmt: skip
def _(t):
    rows = add_features(t.readings)
    names = F.array(*[F.lit(n) for n in feature_list(rows)])
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(names).alias("feature"), "rows")
