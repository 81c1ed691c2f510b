"""Calendar profiles, trends, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import c
from ..operators import profiles
from .base import query

_STATS = "avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max, count({v}) AS count"
_DOUBLES = "mean std min max"
_POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]
_EVENT_STATS = _STATS.format(v="value")
_ORDER_STATS = _STATS.format(v="o_totalprice")

_HOURS = f"SELECT hour(ts) AS hour, {_EVENT_STATS} FROM events GROUP BY 1"
_DAYS = f"SELECT dayofweek(ts) + 1 AS dayofweek, {_EVENT_STATS} FROM events GROUP BY 1"
_MONTHS = f"SELECT month(o_orderdate) AS month, {_ORDER_STATS} FROM orders GROUP BY 1"
_YEARS = f"SELECT year(o_orderdate) AS year, {_ORDER_STATS} FROM orders GROUP BY 1"


def _hours(t, **how):
    return profiles.profile(t.events, "value", "hour", "ts", **how)


def _days(t):
    return profiles.profile(t.events, "value", "dayofweek", "ts")


def _months(t, **how):
    return profiles.profile(t.orders, "o_totalprice", "month", "o_orderdate", **how)


def _years(t, **how):
    return profiles.profile(t.orders, "o_totalprice", "year", "o_orderdate", **how)


@query("hour_profile", _HOURS, doubles=_DOUBLES)
def _(t):
    return _hours(t)


@query("hour_profile_per_type", f"""
    SELECT event_type, hour(ts) AS hour, {_EVENT_STATS} FROM events GROUP BY 1, 2
    """, doubles=_DOUBLES)  # fmt: skip
def _(t):
    return _hours(t, keys=["event_type"])


@query("weekday_profile", f"""
    SELECT dayofweek(ts) + 1 AS dayofweek, dayname(ts) AS day_name, {_EVENT_STATS} FROM events GROUP BY 1, 2
    """, doubles=_DOUBLES)  # fmt: skip
def _(t):
    return _days(t)


@query("month_profile", f"""
    SELECT month(o_orderdate) AS month, strftime(o_orderdate, '%b') AS month_name, {_ORDER_STATS}
    FROM orders GROUP BY 1, 2
    """, doubles=_DOUBLES, digits=4)  # fmt: skip
def _(t):
    return _months(t)


@query("month_profile_long_names", f"""
    SELECT month(o_orderdate) AS month, monthname(o_orderdate) AS month_name, {_ORDER_STATS}
    FROM orders GROUP BY 1, 2
    """, doubles=_DOUBLES, digits=4)  # fmt: skip
def _(t):
    return _months(t, short_months=False)


@query("year_profile", _YEARS, doubles=_DOUBLES, digits=4)
def _(t):
    return _years(t)


def _extremes_sql(table: str, bucket: str) -> str:
    return f"""
    WITH p AS ({table})
    SELECT h.{bucket} AS peak_{bucket}, h.mean AS peak_mean, h.max AS peak_max,
           l.{bucket} AS low_{bucket}, l.mean AS low_mean, l.min AS low_min
    FROM (SELECT * FROM p ORDER BY mean DESC, {bucket} LIMIT 1) h,
         (SELECT * FROM p ORDER BY mean, {bucket} LIMIT 1) l
    """


_EXTREME_DOUBLES = "peak_mean peak_max low_mean low_min"


@query("hour_extremes", _extremes_sql(_HOURS, "hour"), doubles=_EXTREME_DOUBLES)
def _(t):
    return profiles.extremes(_hours(t), "hour")


@query("weekday_extremes", _extremes_sql(_DAYS, "dayofweek"), doubles=_EXTREME_DOUBLES)
def _(t):
    return profiles.extremes(_days(t), "dayofweek")


@query("month_extremes", _extremes_sql(_MONTHS, "month"), doubles=_EXTREME_DOUBLES, digits=4)
def _(t):
    return profiles.extremes(_months(t), "month")


@query("hour_extremes_per_type", f"""
    WITH p AS (SELECT event_type, hour(ts) AS hour, {_EVENT_STATS} FROM events GROUP BY 1, 2),
    h AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, hour) = 1),
    l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean, hour) = 1)
    SELECT h.event_type, h.hour AS peak_hour, h.mean AS peak_mean, h.max AS peak_max,
           l.hour AS low_hour, l.mean AS low_mean, l.min AS low_min
    FROM h JOIN l USING (event_type)
    """, doubles=_EXTREME_DOUBLES)  # fmt: skip
def _(t):
    return profiles.extremes(_hours(t, keys=["event_type"]), "hour", by=["event_type"])


@query("hour_variation", f"""
    WITH p AS ({_HOURS})
    SELECT max(mean) - min(mean) AS range, avg(std / mean) AS coefficient_of_variation FROM p
    """, doubles="range coefficient_of_variation")  # fmt: skip
def _(t):
    return profiles.variation(_hours(t))


@query("weekend_split", f"""
    WITH p AS ({_DAYS}),
    w AS (SELECT avg(mean) FILTER (WHERE dayofweek IN (1, 7)) AS weekend_average,
                 avg(mean) FILTER (WHERE dayofweek NOT IN (1, 7)) AS weekday_average FROM p)
    SELECT *, weekend_average - weekday_average AS difference,
           (weekend_average - weekday_average) / weekday_average * 100 AS percent_difference FROM w
    """, doubles="weekend_average weekday_average difference percent_difference")  # fmt: skip
def _(t):
    return profiles.weekend_split(_days(t))


_SEASONS = """
    avg(mean) FILTER (WHERE month IN (3, 4, 5)) AS spring_average,
    avg(mean) FILTER (WHERE month IN (6, 7, 8)) AS summer_average,
    avg(mean) FILTER (WHERE month IN (9, 10, 11)) AS fall_average,
    avg(mean) FILTER (WHERE month IN (12, 1, 2)) AS winter_average
    """


@query(
    "season_averages",
    f"WITH p AS ({_MONTHS}) SELECT {_SEASONS} FROM p",
    doubles="spring_average summer_average fall_average winter_average",
    digits=4,
)
def _(t):
    return profiles.season_averages(_months(t))


_TREND = """
    SELECT count(mean) AS n_years, regr_slope(mean, year) AS slope, regr_intercept(mean, year) AS intercept,
           corr(mean, year) AS correlation, avg(yoy) AS average_percent_change,
           CASE WHEN regr_slope(mean, year) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
           CASE WHEN abs(corr(mean, year)) > 0.7 THEN 'strong' WHEN abs(corr(mean, year)) > 0.3 THEN 'moderate'
                ELSE 'weak' END AS trend_strength,
           'ok' AS status
    """


@query("yearly_trend", f"""
    WITH p AS ({_YEARS}),
    c AS (SELECT *, (mean - lag(mean) OVER (ORDER BY year)) / lag(mean) OVER (ORDER BY year) * 100 AS yoy FROM p)
    {_TREND} FROM c
    """, doubles="slope intercept correlation average_percent_change", digits=4)  # fmt: skip
def _(t):
    return profiles.yearly_trend(_years(t))


@query("yearly_trend_per_status", f"""
    WITH p AS (SELECT o_orderstatus, year(o_orderdate) AS year, {_ORDER_STATS} FROM orders GROUP BY 1, 2),
    c AS (SELECT *, (mean - lag(mean) OVER w) / lag(mean) OVER w * 100 AS yoy FROM p
          WINDOW w AS (PARTITION BY o_orderstatus ORDER BY year))
    {_TREND}, o_orderstatus FROM c GROUP BY o_orderstatus
    """, doubles="slope intercept correlation average_percent_change", digits=4)  # fmt: skip
def _(t):
    years = _years(t, keys=["o_orderstatus"])
    return profiles.yearly_trend(years, by=["o_orderstatus"])


@query("yearly_trend_short", """
    SELECT count(DISTINCT year(ts)) AS n_years, 'insufficient' AS status, CAST(NULL AS VARCHAR) AS trend_strength
    FROM events
    """)  # fmt: skip
def _(t):
    years = profiles.profile(t.events, "value", "year", "ts")
    return profiles.yearly_trend(years).select("n_years", "status", "trend_strength")


@query("yearly_changes", f"""
    WITH p AS ({_YEARS})
    SELECT year, (mean - lag(mean) OVER (ORDER BY year)) / lag(mean) OVER (ORDER BY year) * 100 AS yoy_change FROM p
    """, doubles="yoy_change")  # fmt: skip
def _(t):
    return profiles.yearly_changes(_years(t)).select("year", "yoy_change")


@query("monotonic_trend", f"""
    WITH p AS (SELECT o_orderpriority, year(o_orderdate) AS year, {_ORDER_STATS} FROM orders GROUP BY 1, 2),
    c AS (SELECT o_orderpriority, mean, lag(mean) OVER (PARTITION BY o_orderpriority ORDER BY year) AS b FROM p)
    SELECT o_orderpriority, CASE WHEN coalesce(bool_and(mean >= b), true) THEN 'increasing'
                WHEN coalesce(bool_and(mean <= b), true) THEN 'decreasing' ELSE 'variable' END AS trend
    FROM c GROUP BY 1
    """)  # fmt: skip
def _(t):
    return profiles.monotonic_trend(_years(t, keys=["o_orderpriority"]), by=["o_orderpriority"])


_LONG = "long AS (" + " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, datetime, "{v}" AS x FROM readings""" for v in _POLLUTANTS
) + ")"
_BUCKETS = {
    "hour": "hour(datetime)",
    "dayofweek": "dayofweek(datetime) + 1",
    "month": "month(datetime)",
    "year": "year(datetime)",
}
_EVERY = " UNION ALL ".join(
    f"SELECT variable, '{b}' AS bucket, {e} AS bucket_value, {_STATS.format(v='x')} FROM long GROUP BY 1, 3"
    for b, e in _BUCKETS.items()
)


@query("all_profiles", f"WITH {_LONG} {_EVERY}", views="readings", doubles=_DOUBLES)
def _(t):
    return profiles.profiles(t.readings, _POLLUTANTS)


_CHECK_LONG = """long AS (
    SELECT 'l_quantity' AS variable, l_shipdate AS datetime, l_quantity AS x FROM lineitem
    UNION ALL SELECT 'l_extendedprice', l_shipdate, l_extendedprice FROM lineitem)"""


@query("all_profiles_lineitem", f"WITH {_CHECK_LONG} {_EVERY}", doubles=_DOUBLES, digits=4)
def _(t):
    return profiles.profiles(t.lineitem, ["l_quantity", "l_extendedprice"], "l_shipdate")


@query("insights", f"""
    WITH {_CHECK_LONG}, every AS ({_EVERY}),
    peak AS (SELECT * FROM every WHERE mean IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY variable, bucket ORDER BY mean DESC, bucket_value) = 1),
    season AS (SELECT variable, CASE WHEN bucket_value IN (3, 4, 5) THEN 'spring'
                   WHEN bucket_value IN (6, 7, 8) THEN 'summer' WHEN bucket_value IN (9, 10, 11) THEN 'fall'
                   ELSE 'winter' END AS season, avg(mean) AS m
               FROM every WHERE bucket = 'month' GROUP BY 1, 2),
    trend AS (SELECT variable, regr_slope(mean, bucket_value) AS slope, corr(mean, bucket_value) AS r
              FROM every WHERE bucket = 'year' GROUP BY 1)
    SELECT v.variable,
           (SELECT bucket_value FROM peak p WHERE p.variable = v.variable AND bucket = 'hour') AS peak_hour,
           (SELECT dayname(DATE '2023-01-01' + CAST(bucket_value - 1 AS INTEGER)) FROM peak p
            WHERE p.variable = v.variable AND bucket = 'dayofweek') AS peak_day,
           (SELECT strftime(make_date(2023, CAST(bucket_value AS INTEGER), 1), '%b') FROM peak p
            WHERE p.variable = v.variable AND bucket = 'month') AS peak_month,
           (SELECT arg_max(season, m) FROM season s WHERE s.variable = v.variable) AS highest_season,
           (SELECT arg_min(season, m) FROM season s WHERE s.variable = v.variable) AS lowest_season,
           CASE WHEN t.slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
           CASE WHEN abs(t.r) > 0.7 THEN 'strong' WHEN abs(t.r) > 0.3 THEN 'moderate' ELSE 'weak' END
               AS trend_strength,
           t.r AS trend_correlation
    FROM (SELECT DISTINCT variable FROM long) v JOIN trend t USING (variable)
    """, doubles="trend_correlation")  # fmt: skip
def _(t):
    return profiles.insights(t.lineitem, ["l_quantity", "l_extendedprice"], "l_shipdate")


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, count(*) AS rows, 12 AS columns, min(datetime) AS start,
        max(datetime) AS "end", avg("{v}") AS mean, stddev_samp("{v}") AS std, min("{v}") AS min,
        max("{v}") AS max, count(*) - count("{v}") AS null_count, median("{v}") AS median,
        arg_max("{v}", datetime) FILTER (WHERE "{v}" IS NOT NULL) AS latest,
        arg_max("{v}", datetime) FILTER (WHERE "{v}" IS NOT NULL) - avg("{v}") AS latest_minus_mean
        FROM readings"""
    for v in _POLLUTANTS
)


@query(
    "dataset_summary",
    f"SELECT * EXCLUDE (latest, latest_minus_mean) FROM ({_SUMMARY})",
    views="readings",
    doubles=f"{_DOUBLES} median",
)
def _(t):
    return profiles.summary(t.readings, _POLLUTANTS)


@query(
    "value_stats",
    f"SELECT * EXCLUDE (null_count) FROM ({_SUMMARY})",
    views="readings",
    doubles=f"{_DOUBLES} median latest latest_minus_mean",
)
def _(t):
    return profiles.summary(t.readings, _POLLUTANTS, latest=True).drop("null_count")


_LINE_COLUMNS = {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "bigint"),
    "l_linenumber": "int",
    **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "double"),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], "string"),
    "l_shipdate": "timestamp_ntz",
}
_COUNTERS = " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", '{k}' AS type, count(*) - count({n}) AS null_count,
        count(DISTINCT {n}) AS distinct_count, count(*) AS rows, {len(_LINE_COLUMNS)} AS columns,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_LINE_COLUMNS)} FROM lineitem)) AS duplicate_rows,
        0 AS total_nulls FROM lineitem"""
    for n, k in _LINE_COLUMNS.items()
)


@query("quality_counters", _COUNTERS)
def _(t):
    return profiles.quality_counters(t.lineitem)


@query("daily_means", """
    WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
    c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d)
    SELECT CAST(c.day AS TIMESTAMP) AS day, d.mean FROM c LEFT JOIN d USING (day)
    """, doubles="mean", digits=4)  # fmt: skip
def _(t):
    return profiles.daily_means(t.orders, "o_totalprice", "o_orderdate")


@query("daily_means_per_user", """
    WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS mean FROM events GROUP BY 1, 2),
    c AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d GROUP BY 1)
    SELECT c.user_id, CAST(c.day AS TIMESTAMP) AS day, d.mean FROM c LEFT JOIN d USING (user_id, day)
    """, doubles="mean")  # fmt: skip
def _(t):
    return profiles.daily_means(t.events, "value", "ts", keys=["user_id"])


@query("overall_stats", "SELECT avg(value) AS mean, stddev_samp(value) AS std FROM events", doubles="mean std")
def _(t):
    return profiles.overall(t.events, "value")


@query("latest_minus_mean", """
    SELECT (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) - avg(value) AS latest_minus_mean
    FROM events
    """, doubles="latest_minus_mean")  # fmt: skip
def _(t):
    rows = profiles.summary(t.events.select("ts", "event_id", c("value")), ["value"], "ts", latest=True, tie=["event_id"])
    return rows.select(F.col("latest_minus_mean"))
