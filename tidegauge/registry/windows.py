"""Row-relative columns, each in the plain and in the sliced layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import c
from ..operators import windows
from ..operators.order import AUTO, Layout
from .base import query

_ORDER = ["ts", "event_id"]
_SLICED = Layout("sliced", slice_rows=1_000)


def both(name: str, sql: str, **options):
    """Register the query once per layout; both must give the same rows."""

    def register(fn):
        query(name, sql, **options)(lambda t: fn(t, AUTO))
        query(f"{name}_sliced", sql, **options)(lambda t: fn(t, _SLICED))
        return fn

    return register


def _events(t, *extra):
    return t.events.select("event_id", "ts", "value", *extra)


@both("lags", """
    SELECT event_id, user_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 24) OVER w AS value_lag_24
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """)  # fmt: skip
def _(t, layout):
    rows = windows.lags(_events(t, "user_id"), ["value"], keys=["user_id"], order=_ORDER, layout=layout)
    return rows.select("event_id", "user_id", "value_lag_1", "value_lag_24")


@query("lags_one_series", """
    SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 24) OVER w AS value_lag_24,
           lag(value, 168) OVER w AS value_lag_168
    FROM events WINDOW w AS (ORDER BY ts, event_id)
    """)  # fmt: skip
def _(t):
    rows = windows.lags(_events(t), ["value"], (1, 24, 168), order=_ORDER, layout=_SLICED)
    return rows.drop("ts", "value")


@both("lag_backfilled", """
    SELECT event_id, user_id, coalesce(lag(value) OVER w, first_value(value) OVER w) AS value_lag1
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """)  # fmt: skip
def _(t, layout):
    rows = windows.lags(
        _events(t, "user_id"), ["value"], [1], keys=["user_id"], order=_ORDER,
        name=lambda v, k: f"{v}_lag{k}", backfill=True, layout=layout,
    )
    return rows.select("event_id", "user_id", "value_lag1")


_MEAN_DOUBLES = {"doubles": "mean24", "views": "gaps"}


@both("rolling_mean_partial", """
    SELECT event_id, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean24
    FROM gaps
    """, **_MEAN_DOUBLES)  # fmt: skip
def _(t, layout):
    rows = windows.rolling_mean(t.gaps, ["value"], 24, order=_ORDER, name=lambda v, n: "mean24", layout=layout)
    return rows.select("event_id", "mean24")


@both("rolling_mean_full", """
    SELECT event_id, user_id, CASE WHEN count(value) OVER w = 24 THEN avg(value) OVER w END AS mean24
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
    """, doubles="mean24")  # fmt: skip
def _(t, layout):
    rows = windows.rolling_mean(
        _events(t, "user_id"), ["value"], 24, keys=["user_id"], order=_ORDER, min_periods=24,
        name=lambda v, n: "mean24", layout=layout,
    )
    return rows.select("event_id", "user_id", "mean24")


@both("centred_mean", """
    SELECT event_id, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS mean7
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    """, doubles="mean7")  # fmt: skip
def _(t, layout):
    rows = windows.rolling_mean(
        _events(t), ["value"], 7, order=_ORDER, min_periods=7, centred=True,
        name=lambda v, n: "mean7", layout=layout,
    )
    return rows.select("event_id", "mean7")


@both("rolling_corr", """
    WITH l AS (SELECT event_id, ts, value, lag(value, 24) OVER (ORDER BY ts, event_id) AS y FROM events)
    SELECT event_id, CASE WHEN count(y) OVER w = 24 THEN corr(value, y) OVER w END AS r
    FROM l WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
    """, doubles="r")  # fmt: skip
def _(t, layout):
    rows = windows.rolling_corr(_events(t), "value", 24, order=_ORDER, name="r", layout=layout)
    return rows.select("event_id", "r")


@both("gap_hours", """
    SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 3.6e9::DOUBLE AS gap_hours
    FROM events
    """, doubles="gap_hours")  # fmt: skip
def _(t, layout):
    return windows.gap_hours(_events(t), "ts", tie=["event_id"], layout=layout).select("event_id", "gap_hours")


@both("direction_of_change", """
    SELECT event_id, event_type, CAST(sign(value - lag(value) OVER w) AS DOUBLE) AS value_direction
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
    """, doubles="value_direction")  # fmt: skip
def _(t, layout):
    rows = windows.direction_of_change(
        _events(t, "event_type"), ["value"], keys=["event_type"], order=_ORDER, layout=layout
    )
    return rows.select("event_id", "event_type", "value_direction")


@both("supervised_windows", """
    WITH n AS (SELECT event_id, user_id, value, row_number() OVER w AS rn,
                      string_agg(CAST(value AS VARCHAR), ',') OVER (
                          PARTITION BY user_id ORDER BY ts, event_id
                          ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS history
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, history, value AS label FROM n WHERE rn > 24
    """)  # fmt: skip
def _(t, layout):
    rows = windows.supervised_windows(
        _events(t, "user_id"), "value", 24, keys=["user_id"], order=_ORDER, layout=layout
    )
    history = F.array_join(F.transform("window", lambda x: x.cast("string")), ",")
    return rows.select("event_id", "user_id", history.alias("history"), "label")


_SMOOTH = """
    WITH RECURSIVE n AS (
        SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM gaps WHERE value IS NOT NULL),
    s AS (
        SELECT event_id, user_id, rn, value AS smoothed FROM n WHERE rn = 1
        UNION ALL
        SELECT n.event_id, n.user_id, n.rn, 0.3::DOUBLE * n.value + 0.7::DOUBLE * s.smoothed
        FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)
    SELECT event_id, user_id, smoothed FROM s
    """


@both("smoothed", _SMOOTH, views="gaps", doubles="smoothed")
def _(t, layout):
    rows = windows.smooth(t.gaps, "value", 0.3, keys=["user_id"], order=_ORDER, layout=layout)
    return rows.select("event_id", "user_id", "smoothed")


@query("percent_change", """
    WITH y AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
    SELECT year, mean, (mean - lag(mean) OVER (ORDER BY year)) / lag(mean) OVER (ORDER BY year) * 100 AS change
    FROM y
    """, doubles="mean change")  # fmt: skip
def _(t):
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg(c("o_totalprice")).alias("mean"))
    return windows.percent_change(years, "mean", "year", name="change")


_AUTO = """
    WITH l AS (SELECT value, {lags} FROM events WINDOW w AS (ORDER BY ts, event_id))
    {rows}
    """


def _auto_sql(steps, extra: str = "") -> str:
    lagged = ", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in steps)
    rows = "\nUNION ALL\n".join(
        f"SELECT {k} AS lag, count(l{k}) AS pairs, corr(value, l{k}) AS r, count(value) AS points FROM l"
        for k in steps
    )
    return _AUTO.format(lags=lagged, rows=rows)


@both("autocorrelation", _auto_sql((1, 24, 168)), doubles="r")
def _(t, layout):
    return windows.autocorrelation(
        _events(t), "value", order=_ORDER, min_points=48, min_pairs=10, layout=layout
    )


@query("autocorrelation_wide", _auto_sql((1, 6, 12, 24, 48, 72, 168)), doubles="r")
def _(t):
    from ..operators.dependence import LAGS_WIDE

    return windows.autocorrelation(_events(t), "value", LAGS_WIDE, order=_ORDER)


@query("autocorrelation_per_user", """
    WITH l AS (SELECT user_id, value, lag(value, 1) OVER w AS l1, lag(value, 24) OVER w AS l24
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, count(value) AS points, count(l1) AS n1, corr(value, l1) AS r1,
                 count(l24) AS n24, corr(value, l24) AS r24 FROM l GROUP BY 1)
    SELECT user_id, points, 1 AS lag, n1 AS pairs, r1 AS r FROM r WHERE points >= 48 AND n1 > 10
    UNION ALL
    SELECT user_id, points, 24, n24, r24 FROM r WHERE points >= 48 AND n24 > 10
    """, doubles="r")  # fmt: skip
def _(t):
    return windows.autocorrelation(
        _events(t, "user_id"), "value", (1, 24), keys=["user_id"], order=_ORDER,
        min_points=48, min_pairs=10,
    )
