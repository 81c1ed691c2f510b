"""Gap filling, outliers, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators.order import Layout, number_rows
from ..operators.quantiles import quantiles
from .base import query

_ORDER = ["ts", "event_id"]
_SLICED = Layout("sliced", slice_rows=1_000)

_FILL_ONE = """
    SELECT event_id, coalesce(value, lag(value) OVER (ORDER BY ts, event_id)) AS value FROM gaps
    """


@query("fill_previous", _FILL_ONE, views="gaps")
def _(t):
    return clean.fill_previous(t.gaps, ["value"], order=_ORDER).select("event_id", "value")


@query("fill_previous_sliced", _FILL_ONE, views="gaps")
def _(t):
    rows = clean.fill_previous(t.gaps, ["value"], order=_ORDER, layout=_SLICED)
    return rows.select("event_id", "value")


@query("fill_mean", """
    SELECT event_id, coalesce(value, (SELECT avg(value) FROM gaps)) AS value FROM gaps
    """, views="gaps", doubles="value")  # fmt: skip
def _(t):
    return clean.fill_mean(t.gaps, ["value"]).select("event_id", "value")


_FFILL = """
    SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM gaps
    """
_BFILL = """
    SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM gaps
    """
_BOTH = """
    WITH f AS (SELECT event_id, ts, event_type, last_value(value IGNORE NULLS) OVER (
        PARTITION BY event_type ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gaps)
    SELECT event_id, event_type, coalesce(value, first_value(value IGNORE NULLS) OVER (
        PARTITION BY event_type ORDER BY ts, event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM f
    """


def _filled(t, fill, key, layout):
    rows = t.gaps.select("event_id", "ts", key, "value")
    return fill(rows, ["value"], keys=[key], order=_ORDER, layout=layout).drop("ts")


for _name, _fill, _key, _sql in (
    ("ffill", clean.ffill, "user_id", _FFILL),
    ("bfill", clean.bfill, "user_id", _BFILL),
    ("ffill_bfill", clean.ffill_bfill, "event_type", _BOTH),
):
    query(_name, _sql, views="gaps")(
        lambda t, fill=_fill, key=_key: _filled(t, fill, key, Layout())
    )
    query(f"{_name}_sliced", _sql, views="gaps")(
        lambda t, fill=_fill, key=_key: _filled(t, fill, key, _SLICED)
    )


@query("ffill_one_series", """
    SELECT event_id, last_value(value IGNORE NULLS) OVER (
        ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM gaps
    """, views="gaps")  # fmt: skip
def _(t):
    rows = t.gaps.select("event_id", "ts", "value")
    return clean.ffill(rows, ["value"], order=_ORDER, layout=_SLICED).drop("ts")


_RN = """
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
    FROM events
    """


@query("row_numbers_sliced", _RN)
def _(t):
    rows = t.events.select("event_id", "ts", "user_id")
    return number_rows(rows, keys=["user_id"], order=_ORDER, layout=_SLICED).drop("ts")


@query("iqr_sequential", """
    WITH b1 AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem),
    k1 AS (SELECT l.* FROM lineitem l, b1
           WHERE l_quantity BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a)),
    b2 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM k1),
    k2 AS (SELECT k1.* FROM k1, b2
           WHERE l_extendedprice BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a))
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM k2
    """)  # fmt: skip
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    return clean.iqr_filter(rows, ["l_quantity", "l_extendedprice"], 0.3)


@query("iqr_joint", """
    WITH b AS (SELECT quantile_cont("PM2.5", 0.25) AS a1, quantile_cont("PM2.5", 0.75) AS b1,
                      quantile_cont(PM10, 0.25) AS a2, quantile_cont(PM10, 0.75) AS b2 FROM readings)
    SELECT datetime, "PM2.5", PM10 FROM readings, b
    WHERE "PM2.5" BETWEEN a1 - 1.5 * (b1 - a1) AND b1 + 1.5 * (b1 - a1)
      AND PM10 BETWEEN a2 - 1.5 * (b2 - a2) AND b2 + 1.5 * (b2 - a2)
    """, views="readings", doubles="PM2.5 PM10")  # fmt: skip
def _(t):
    rows = t.readings.select("datetime", F.col("`PM2.5`"), "PM10")
    return clean.iqr_filter(rows, ["PM2.5", "PM10"], mode="joint")


_QUARTILES = """
    SELECT 'l_quantity' AS variable, p AS prob,
           CASE p WHEN 0.25 THEN quantile_cont(l_quantity, 0.25) WHEN 0.5 THEN quantile_cont(l_quantity, 0.5)
                  ELSE quantile_cont(l_quantity, 0.75) END AS quantile
    FROM lineitem, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p) GROUP BY p
    UNION ALL
    SELECT 'l_extendedprice', p,
           CASE p WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25)
                  WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
                  ELSE quantile_cont(l_extendedprice, 0.75) END
    FROM lineitem, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p) GROUP BY p
    """


@query("quartiles", _QUARTILES, doubles="prob quantile")
def _(t):
    return quantiles(t.lineitem, ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.75])


@query("quartiles_bracketed", _QUARTILES, doubles="prob quantile")
def _(t):
    how = Layout("sliced", limit=1_000)
    return quantiles(t.lineitem, ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.75], layout=how)


@query("dedupe_ts", """
    SELECT o_orderdate, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) = 1
    """)  # fmt: skip
def _(t):
    rows = t.orders.select("o_orderdate", "o_orderkey", "o_totalprice")
    return clean.dedupe_ts(rows, "o_orderdate", tie=["o_orderkey"])


@query("require_values", """
    SELECT datetime, "PM2.5", SO2 FROM readings WHERE "PM2.5" IS NOT NULL AND SO2 IS NOT NULL
    """, views="readings", doubles="PM2.5 SO2")  # fmt: skip
def _(t):
    rows = t.readings.select("datetime", F.col("`PM2.5`"), "SO2")
    return clean.require_values(rows, ["PM2.5", "SO2", "absent"])


POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]


def clean_sql(source: str = "readings", first: str = "") -> str:
    """Fill by one step, then by the mean, then outliers column by column, then one row per stamp."""
    lagged = ", ".join(
        f'coalesce("{v}", lag("{v}") OVER (ORDER BY datetime)) AS "{v}"' for v in POLLUTANTS
    )
    others = "datetime, temperature, humidity, pressure, wind_speed, wind_direction"
    mean = ", ".join(f'coalesce("{v}", (SELECT avg("{v}") FROM f0)) AS "{v}"' for v in POLLUTANTS)
    steps = [f"f0 AS (SELECT {others}, {lagged} FROM {source})", f"s0 AS (SELECT {others}, {mean} FROM f0)"]
    for i, v in enumerate(POLLUTANTS):
        steps.append(
            f'q{i} AS (SELECT quantile_cont("{v}", 0.25) AS a, quantile_cont("{v}", 0.75) AS b FROM s{i})'
        )
        steps.append(
            f"s{i + 1} AS (SELECT s{i}.* FROM s{i}, q{i} "
            f'WHERE "{v}" BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))'
        )
    return f"WITH {first}" + ",\n".join(steps) + "\n"


_CLEAN_COLUMNS = ", ".join(f'"{v}"' for v in POLLUTANTS)


@query(
    "clean",
    clean_sql() + f"SELECT datetime, {_CLEAN_COLUMNS}, temperature FROM s6",
    views="readings",
    doubles="PM2.5 PM10 NO2 SO2 CO O3 temperature",
)
def _(t):
    rows = clean.clean(t.readings, POLLUTANTS)
    return rows.select("datetime", *[F.col(f"`{v}`") for v in POLLUTANTS], "temperature")


def clean_per_key_sql(source: str, key: str, ids: str, own: str, values: list[str]) -> str:
    """The steps of a cleaning per key, up to a table ``cleaned``; ``own`` is the window of a series."""
    lagged = ", ".join(f'coalesce("{v}", lag("{v}") OVER ({own})) AS "{v}"' for v in values)
    mean = ", ".join(f'coalesce("{v}", avg("{v}") OVER (PARTITION BY {key})) AS "{v}"' for v in values)
    steps = [f"f0 AS (SELECT {ids}, {lagged} FROM {source})", f"s0 AS (SELECT {ids}, {mean} FROM f0)"]
    for i, v in enumerate(values):
        steps.append(
            f'q{i} AS (SELECT {key}, quantile_cont("{v}", 0.25) AS a, quantile_cont("{v}", 0.75) AS b FROM s{i} GROUP BY {key})'
        )
        steps.append(
            f"s{i + 1} AS (SELECT s{i}.* FROM s{i} JOIN q{i} ON s{i}.{key} IS NOT DISTINCT FROM q{i}.{key} "
            f'WHERE a IS NULL OR "{v}" BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))'
        )
    order = own.split("ORDER BY ")[1]
    stamp = order.split(",")[0]
    steps.append(
        f"cleaned AS (SELECT * FROM s{len(values)} "
        f"QUALIFY row_number() OVER (PARTITION BY {key}, {stamp} ORDER BY {order}) = 1)"
    )
    return ",\n".join(steps)


_OWN = "PARTITION BY event_type ORDER BY ts, event_id"
_KEYED = "WITH " + clean_per_key_sql("gaps", "event_type", "event_id, ts, event_type", _OWN, ["value"])


@query("fill_mean_per_key", """
    SELECT event_id, event_type, coalesce(value, avg(value) OVER (PARTITION BY event_type)) AS value FROM gaps
    """, views="gaps", doubles="value")  # fmt: skip
def _(t):
    return clean.fill_mean(t.gaps.select("event_id", "event_type", "value"), ["value"], keys=["event_type"])


_IQR_KEYED = """
    WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
    SELECT event_id, user_id, value FROM events JOIN q USING (user_id) WHERE value BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)
    """


def _iqr_per_key(t, layout: Layout):
    rows = t.events.select("event_id", "user_id", "value")
    return clean.iqr_filter(rows, ["value"], 0.4, keys=["user_id"], layout=layout)


@query("iqr_per_key", _IQR_KEYED)
def _(t):
    return _iqr_per_key(t, Layout())


@query("iqr_per_key_bracketed", _IQR_KEYED)
def _(t):
    """Every user is a large group here; all of them are searched in the same passes."""
    return _iqr_per_key(t, Layout(limit=5))


@query("clean_per_key", _KEYED + " SELECT event_id, event_type, value FROM cleaned", views="gaps", doubles="value")
def _(t):
    rows = clean.clean(t.gaps, ["value"], "ts", keys=["event_type"], tie=["event_id"])
    return rows.select("event_id", "event_type", "value")


@query("quartiles_per_key", """
    SELECT l_suppkey, 'l_quantity' AS variable, p AS prob,
           CASE p WHEN 0.25 THEN quantile_cont(l_quantity, 0.25) ELSE quantile_cont(l_quantity, 0.75) END AS quantile
    FROM lineitem, (SELECT unnest([0.25::DOUBLE, 0.75]) AS p) GROUP BY l_suppkey, p
    """, doubles="prob quantile")  # fmt: skip
def _(t):
    return quantiles(t.lineitem, ["l_quantity"], [0.25, 0.75], by=["l_suppkey"], layout=Layout(limit=50))


@query("fill_previous_auto", _FILL_ONE, views="gaps")
def _(t):
    """Sliced because the table is larger than the limit, not because it was asked for."""
    rows = clean.fill_previous(t.gaps, ["value"], order=_ORDER, layout=Layout(limit=1_000, slice_rows=1_000))
    return rows.select("event_id", "value")


@query("ffill_auto", _FFILL, views="gaps")
def _(t):
    return _filled(t, clean.ffill, "user_id", Layout(limit=5, slice_rows=1_000))
