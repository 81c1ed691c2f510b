"""Sources, sinks, row and column selection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..columns import c, hour_start
from ..operators import evaluate, select
from ..session import fresh_folder
from ..sources import history, readings, snapshots
from .base import Tables, query

_VALUES = '"PM2.5" PM10 NO2 SO2 CO O3 temperature humidity pressure wind_speed wind_direction'
_ALL = _VALUES.replace('"', "")


def _as_text(t: Tables):
    """The readings as a file has them: time as text, values as numbers."""
    text = F.date_format("datetime", readings.TIME_FORMAT)
    return t.readings.withColumn("datetime", text)


def _csv(t: Tables) -> str:
    folder = fresh_folder(t.spark, "readings-csv")
    readings.write_csv(_as_text(t), folder)
    return folder


@query(
    "csv_with_schema",
    "SELECT * REPLACE (strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime) FROM readings",
    views="readings",
    doubles=_ALL,
)
def _(t):
    return readings.read_readings_csv(t.spark, _csv(t))


@query("csv_inferred", "SELECT * FROM readings", views="readings", doubles=_ALL)
def _(t):
    rows = readings.read_csv_inferred(t.spark, _csv(t))
    return rows.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query("csv_bad_cells", """
    SELECT event_id, datetime, TRY_CAST(value AS DOUBLE) AS value FROM text_times
    """, views="text_times", doubles="value")  # fmt: skip
def _(t):
    folder = fresh_folder(t.spark, "bad-csv")
    readings.write_csv(t.text_times, folder)
    schema = "event_id bigint, datetime string, value double"
    return readings.read_readings_csv(t.spark, folder, schema)


@query("parquet_scan", "SELECT event_id, ts, value FROM events")
def _(t):
    return readings.read_parquet(t.spark, t.path("events")).select("event_id", "ts", "value")


@query("latest_snapshot", """
    SELECT event_id, value, 'processed_20240131_000000' AS snapshot FROM events
    WHERE event_type IN ('view', 'signup')
    """)  # fmt: skip
def _(t):
    folder = fresh_folder(t.spark, "snapshots")
    rows = t.events.select("event_id", "value", "event_type")
    late = F.col("event_type").isin("view", "signup")
    for which, stamp in ((~late, datetime(2024, 1, 2)), (late, datetime(2024, 1, 31))):
        part = rows.where(which).drop("event_type")
        snapshots.write_snapshot(part, folder, snapshots.snapshot_name(stamp))
    return snapshots.latest_snapshot(t.spark, folder)


@query("snapshot_overwrite", """
    SELECT event_id, value, 'processed_20240102_000000' AS snapshot FROM events
    WHERE event_type IN ('purchase', 'error')
    UNION ALL
    SELECT event_id, value, 'processed_20240131_000000' FROM events WHERE event_type IN ('view', 'signup')
    """)  # fmt: skip
def _(t):
    folder = fresh_folder(t.spark, "snapshots")
    rows = t.events.select("event_id", "value", "event_type")
    early, late = (snapshots.snapshot_name(datetime(2024, 1, d)) for d in (2, 31))
    for kinds, name in ((["click"], early), (["view", "signup"], late), (["purchase", "error"], early)):
        part = rows.where(F.col("event_type").isin(kinds)).drop("event_type")
        snapshots.write_snapshot(part, folder, name)
    return t.spark.read.parquet(folder)


@query("time_from_row_order", """
    SELECT event_id, value,
           TIMESTAMP '2024-11-01' + to_hours(CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER)) AS datetime
    FROM events
    """)  # fmt: skip
def _(t):
    return readings.with_time_column(t.events.select("event_id", "value"), order=["event_id"])


@query("time_from_date_column", "SELECT o_orderkey, o_orderdate AS date, o_orderdate AS datetime FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("date"))
    return readings.with_time_column(rows)


@query("history_round_trip", """
    SELECT model_name, target, TIMESTAMP '2024-02-01' AS timestamp, count(*) AS n_samples,
           avg(abs(actual - predicted)) AS mae, avg(actual) AS y_true_mean
    FROM predictions GROUP BY 1, 2
    """, views="predictions", doubles="mae y_true_mean")  # fmt: skip
def _(t):
    scores = evaluate.metrics(t.predictions, by=["model_name", "target"], order=["ts", "event_id"])
    folder = fresh_folder(t.spark, "history")
    stamp = F.lit("2024-02-01")
    history.save_history(evaluate.to_history(scores, "model_name", "target", stamp), folder)
    back = history.load_history(t.spark, folder)
    return back.select(
        "model_name",
        "target",
        "timestamp",
        "n_samples",
        F.col("metrics")["mae"].alias("mae"),
        F.col("statistics")["y_true_mean"].alias("y_true_mean"),
    )


@query("csv_export", """
    SELECT event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1
    """)  # fmt: skip
def _(t):
    folder = fresh_folder(t.spark, "export")
    readings.write_csv(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), folder)
    return t.spark.read.option("header", True).csv(folder)


@query("parse_ts", """
    SELECT event_id, CAST(datetime AS TIMESTAMP) AS datetime, value FROM text_times
    WHERE datetime <> 'n/a'
    """, views="text_times")  # fmt: skip
def _(t):
    return select.parse_ts(t.text_times)


@query("between_ts", """
    SELECT event_id, ts, value FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'
    """)  # fmt: skip
def _(t):
    rows = select.between_ts(t.events, "ts", "2024-01-05 06:00:00", "2024-01-20 18:00:00")
    return rows.select("event_id", "ts", "value")


@query("pick_columns", 'SELECT datetime, "PM2.5", "NO2" FROM readings', views="readings", doubles="PM2.5 NO2")
def _(t):
    return select.pick(t.readings, ["PM2.5", "NO2", "no such column"])


@query("last_n", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(t):
    return select.last_n(t.events.select("event_id", "ts", "value"), order=["ts", "event_id"])


@query("last_n_per_key", """
    SELECT user_id, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10
    """)  # fmt: skip
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", "value")
    return select.last_n(rows, 10, keys=["user_id"], order=["ts", "event_id"])


@query("head_preview", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(t):
    rows = t.events.select("event_id", "value")
    return select.head(rows, 10, [F.col("value").desc(), F.col("event_id")])


@query("to_numbers", "SELECT event_id, TRY_CAST(value AS DOUBLE) AS value FROM text_times", views="text_times")
def _(t):
    return select.to_numbers(t.text_times, ["value"]).select("event_id", "value")


@query("latest_row", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(t):
    return select.latest_row(t.events.select("event_id", "ts", "value"), order=["ts", "event_id"])


@query("latest_row_per_key", """
    SELECT user_id, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """)  # fmt: skip
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", "value")
    return select.latest_row(rows, keys=["user_id"], order=["ts", "event_id"])


@query("hour_starts", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def _(t):
    return t.events.select("event_id", hour_start(c("ts")).alias("hour"))
