"""Scaling, forecasts, evaluation, whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import c
from ..operators import autoreg, catalog, evaluate, forecast, mlprep
from ..operators.clean import ffill_bfill
from ..operators.order import AUTO
from ..operators.quality import row_gate
from ..plans import jobs
from ..session import fresh_folder
from ..sources import readings
from .base import query
from .cleaning import POLLUTANTS, clean_per_key_sql, clean_sql
from .rowwise import FEATURES_SQL
from .rowwise import JOB_FEATURES as _JOB_FEATURES
from .windows import both

_ORDER = ["ts", "event_id"]
_USER = {"keys": ["user_id"], "order": _ORDER}


def _events(t):
    return t.events.select("event_id", "ts", "user_id", "value")


# ---- scaling ---------------------------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scaled_lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS s{i}" for i, v in enumerate(_LINE)
) + " FROM lineitem", doubles="s0 s1 s2 s3")
def _(t):
    rows = mlprep.scale(t.lineitem, _LINE)
    vector = F.col("scaled_features")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.get(vector, F.lit(i)).alias(f"s{i}") for i in range(4)]
    )


_KEPT = " AND ".join(f'"{f}" IS NOT NULL' for f in _JOB_FEATURES)
_SCALED = ", ".join(
    f"coalesce((\"{f}\" - avg(\"{f}\") OVER ()) / nullif(stddev_samp(\"{f}\") OVER (), 0), 0) AS s{i}"
    for i, f in enumerate(_JOB_FEATURES)
)
_JOB_COLUMNS = ", ".join(f'"{v}"' for v in POLLUTANTS)
_WEATHER = "temperature, humidity, pressure, wind_speed, wind_direction"
_FILLED = ", ".join(
    f"""coalesce(last_value("{v}" IGNORE NULLS) OVER (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value("{v}" IGNORE NULLS) OVER (ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS "{v}" """
    for v in POLLUTANTS
)


def _job_sql(source: str = "readings", first: str = "") -> str:
    return (
        clean_sql(source, first).rstrip()
        + f""",
    featured AS (SELECT *, {FEATURES_SQL} FROM s6 WINDOW w AS (ORDER BY datetime)),
    kept AS (SELECT * FROM featured WHERE {_KEPT})
    SELECT datetime, {_JOB_COLUMNS}, "AQI", {_SCALED} FROM kept
    """
    )


_JOB_SQL = _job_sql()
_JOB_DOUBLES = " ".join([*POLLUTANTS, "AQI", *[f"s{i}" for i in range(len(_JOB_FEATURES))]])


def _unpacked(rows):
    vector = F.col("scaled_features")
    parts = [F.get(vector, F.lit(i)).alias(f"s{i}") for i in range(len(_JOB_FEATURES))]
    return rows.select("datetime", *[c(v) for v in POLLUTANTS], "AQI", *parts)


@query("processed_readings", _JOB_SQL, views="readings", doubles=_JOB_DOUBLES)
def _(t):
    rows, _ = jobs.processed(t.readings)
    return _unpacked(rows)


def _csv(t) -> str:
    folder = fresh_folder(t.spark, "job-csv")
    text = F.date_format("datetime", readings.TIME_FORMAT)
    readings.write_csv(t.readings.withColumn("datetime", text), folder)
    return folder


@query("processed_csv", _JOB_SQL, views="readings", doubles=_JOB_DOUBLES, digits=5)
def _(t):
    out = fresh_folder(t.spark, "processed")
    jobs.process_csv(t.spark, _csv(t), out)
    return _unpacked(t.spark.read.parquet(out))


_LAG1 = ", ".join(
    f'coalesce(lag("{v}") OVER (ORDER BY datetime), "{v}") AS "{v}_lag1"' for v in POLLUTANTS
)


@query("processed_light", f"""
    WITH f AS (SELECT datetime, temperature, {_FILLED} FROM readings)
    SELECT datetime, temperature, {_JOB_COLUMNS}, hour(datetime) AS hour, month(datetime) AS month,
           isodow(datetime) - 1 AS day_of_week, CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend,
           round_even(("PM2.5" * 0.4::DOUBLE + PM10 * 0.3::DOUBLE + NO2 * 0.2::DOUBLE + SO2 * 0.1::DOUBLE) * 100, 0) / 100 AS "AQI",
           {_LAG1}
    FROM f
    """, views="readings",
    doubles=" ".join(["temperature", *POLLUTANTS, "AQI", *[f"{v}_lag1" for v in POLLUTANTS]]))
def _(t):
    rows = t.readings.select("datetime", "temperature", *[c(v) for v in POLLUTANTS])
    return jobs.light(rows)


_SHIPPED = POLLUTANTS[:4]
_SHIP_TIE = "l_orderkey, l_linenumber, l_partkey"
_SHIP_FEATURES = [
    f for f in _JOB_FEATURES if f not in {"temperature", "humidity", "pressure", "wind_speed", "wind_direction"} and "_interaction" not in f
]
_SHIP_SCALED = ", ".join(
    f"coalesce((\"{f}\" - avg(\"{f}\") OVER ()) / nullif(stddev_samp(\"{f}\") OVER (), 0), 0) AS s{i}"
    for i, f in enumerate(_SHIP_FEATURES)
)


def _shipments_sql() -> str:
    """Every step per supplier: fill by one row, by the mean, four bounds in turn, one row per stamp, features."""
    own = f"PARTITION BY l_suppkey ORDER BY datetime, {_SHIP_TIE}"
    ids = f"datetime, l_suppkey, {_SHIP_TIE}"
    steps = [clean_per_key_sql("ships", "l_suppkey", ids, own, _SHIPPED)]
    calendar = FEATURES_SQL.split("temperature * humidity")[0]
    lagged = ", ".join(
        f'lag("{v}", {k}) OVER (PARTITION BY l_suppkey ORDER BY datetime) AS "{v}_lag_{k}h"' for v in _SHIPPED[:3] for k in (1, 24)
    )
    kept = " AND ".join(f'"{f}" IS NOT NULL' for f in _SHIP_FEATURES)
    columns = ", ".join(f'"{v}"' for v in _SHIPPED)
    return f"""
    WITH ships AS (
        SELECT l_shipdate AS datetime, l_suppkey, {_SHIP_TIE}, l_quantity AS "PM2.5", l_extendedprice / 1000 AS PM10,
               l_discount * 100 AS NO2, l_tax * 100 AS SO2
        FROM lineitem WHERE l_shipdate IS NOT NULL),
    {", ".join(steps)},
    featured AS (SELECT *, {calendar} {lagged} FROM cleaned),
    kept AS (SELECT * FROM featured WHERE {kept})
    SELECT l_suppkey, datetime, {columns}, "AQI", {_SHIP_SCALED} FROM kept
    """


@query(
    "processed_shipments",
    _shipments_sql(),
    doubles=" ".join([*_SHIPPED, "AQI", *[f"s{i}" for i in range(len(_SHIP_FEATURES))]]),
    digits=5,
)
def _(t):
    """The whole job over every line item as readings of its supplier."""
    rows = t.lineitem.select(
        c("l_shipdate").alias("datetime"),
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        c("l_quantity").alias("PM2.5"),
        (c("l_extendedprice") / 1000).alias("PM10"),
        (c("l_discount") * 100).alias("NO2"),
        (c("l_tax") * 100).alias("SO2"),
    )
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    out, used = jobs.processed(rows, _SHIPPED, keys=["l_suppkey"], tie=tie)
    parts = [F.get("scaled_features", F.lit(used.index(f))).alias(f"s{i}") for i, f in enumerate(_SHIP_FEATURES)]
    return out.select("l_suppkey", "datetime", *[c(v) for v in _SHIPPED], "AQI", *parts)


_INGEST_SQL = _job_sql(
    "filled", f"filled AS (SELECT datetime, {_WEATHER}, {_FILLED} FROM readings),\n"
)


@query("ingested_rows", _INGEST_SQL, views="readings", doubles=_JOB_DOUBLES, digits=5)
def _(t):
    """Validated ingest of the filled readings; the pressure is moved into its plausible range, which scaling undoes."""
    source = fresh_folder(t.spark, "ingest")
    filled = ffill_bfill(t.readings, POLLUTANTS, order=["datetime"])
    readings.write_parquet(filled.withColumn("pressure", c("pressure") / 10 + 900), source)
    out = fresh_folder(t.spark, "ingested")
    jobs.ingest(t.spark, source, out, source="parquet")
    return _unpacked(t.spark.read.parquet(out))


# ---- simple forecasts ------------------------------------------------------------------------

_N = """n AS (SELECT user_id, value, ts, event_id,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
             count(*) OVER (PARTITION BY user_id) AS total FROM events)"""
_STEPS = "steps AS (SELECT unnest(generate_series(1, 24)) AS step)"
_MA = """ma AS (SELECT user_id, avg(value) FILTER (WHERE back <= 24) AS f,
              stddev_samp(value) FILTER (WHERE back <= 48) AS sd
       FROM n WHERE total >= 24 GROUP BY 1)"""


@both("moving_average_forecast", f"""
    WITH {_N}, {_STEPS}, {_MA}
    SELECT user_id, CAST(step AS INTEGER) AS step, f AS forecast, f - 1.96::DOUBLE * sd AS confidence_lower,
           f + 1.96::DOUBLE * sd AS confidence_upper
    FROM ma, steps
    """, doubles="forecast confidence_lower confidence_upper")  # fmt: skip
def _(t, layout):
    return forecast.moving_average_forecast(_events(t), "value", layout=layout, **_USER)


_WMA_STEPS = """w AS (
        SELECT user_id, list(value ORDER BY ts, event_id) AS vals FROM n WHERE back <= 24 AND total >= 24 GROUP BY 1),
    r AS (
        SELECT user_id, 0 AS step, vals, CAST(NULL AS DOUBLE) AS f FROM w
        UNION ALL
        SELECT user_id, step + 1,
               list_append(vals[2:], list_sum(list_transform(range(1, 25), lambda i: vals[i] * (i / 300.0::DOUBLE)))),
               list_sum(list_transform(range(1, 25), lambda i: vals[i] * (i / 300.0::DOUBLE)))
        FROM r WHERE step < 24)"""


@query("weighted_average_forecast", f"""
    WITH RECURSIVE {_N}, {_WMA_STEPS}
    SELECT user_id, step, f AS forecast FROM r WHERE step > 0
    """, doubles="forecast")  # fmt: skip
def _(t):
    return forecast.forecast_paths(_events(t), "value", forecast.weighted_moving_average(), **_USER)


_SN = """sn AS (SELECT s.step, n.user_id, n.value AS f FROM n, steps s
             WHERE total >= 24 AND back = 24 - (s.step - 1) % 24)"""


@query("seasonal_naive_forecast", f"""
    WITH {_N}, {_STEPS}, {_SN} SELECT user_id, CAST(step AS INTEGER) AS step, f AS forecast FROM sn
    """)  # fmt: skip
def _(t):
    return forecast.forecast_paths(_events(t), "value", forecast.seasonal_naive(), **_USER)


@query("seasonal_naive_long_horizon", """
    WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back
               FROM events),
    steps AS (SELECT unnest(generate_series(1, 168)) AS step)
    SELECT event_type, CAST(step AS INTEGER) AS step, value AS forecast FROM n, steps
    WHERE back = 24 - (step - 1) % 24
    """)  # fmt: skip
def _(t):
    rows = t.events.select("event_id", "ts", "event_type", "value")
    return forecast.forecast_paths(
        rows, "value", forecast.seasonal_naive(), 168, keys=["event_type"], order=_ORDER
    )


_ES = """es AS (SELECT user_id, sum(value * CASE WHEN rn = 1 THEN power(0.7::DOUBLE, total - 1)
                     ELSE 0.3::DOUBLE * power(0.7::DOUBLE, total - rn) END) AS f
              FROM n WHERE total >= 10 GROUP BY 1)"""


@both("smoothing_forecast", f"""
    WITH {_N}, {_STEPS}, {_ES} SELECT user_id, CAST(step AS INTEGER) AS step, f AS forecast FROM es, steps
    """, doubles="forecast")  # fmt: skip
def _(t, layout):
    return forecast.forecast_paths(
        _events(t), "value", forecast.exponential_smoothing(), layout=layout, **_USER
    )


_ENSEMBLE = f"""
    WITH RECURSIVE {_N}, {_STEPS}, {_MA}, {_WMA_STEPS}, {_SN}, {_ES},
    j AS (SELECT ma.user_id, CAST(steps.step AS INTEGER) AS step, ma.f AS moving_average,
                 r.f AS weighted_moving_average, sn.f AS seasonal_naive, es.f AS exponential_smoothing
          FROM ma CROSS JOIN steps JOIN r ON r.user_id = ma.user_id AND r.step = steps.step
          JOIN sn ON sn.user_id = ma.user_id AND sn.step = steps.step JOIN es ON es.user_id = ma.user_id),
    a AS (SELECT *, list_avg([moving_average, weighted_moving_average, seasonal_naive, exponential_smoothing]) AS forecast,
                 list_stddev_pop([moving_average, weighted_moving_average, seasonal_naive, exponential_smoothing]) AS sd
          FROM j)
    """
_ENSEMBLE_DOUBLES = " ".join(
    [
        "moving_average weighted_moving_average seasonal_naive exponential_smoothing",
        "forecast confidence_lower confidence_upper",
    ]
)


@query("ensemble_forecast", _ENSEMBLE + """
    SELECT * EXCLUDE (sd), forecast - 1.96::DOUBLE * sd AS confidence_lower,
           forecast + 1.96::DOUBLE * sd AS confidence_upper FROM a
    """, doubles=_ENSEMBLE_DOUBLES)  # fmt: skip
def _(t):
    return forecast.ensemble_forecast(_events(t), "value", **_USER)


@query("forecast_timeline", _ENSEMBLE + """
    SELECT a.user_id, a.step, l.last_ts + to_hours(a.step) AS ts, 'value' AS target, 'ensemble' AS method, forecast
    FROM a JOIN (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1) l USING (user_id)
    """, doubles="forecast")  # fmt: skip
def _(t):
    return forecast.timeline(_events(t), "value", **_USER)


@query("forecast_timeline_one_series", f"""
    WITH s AS (SELECT max(ts) AS last_ts FROM events),
    m AS (SELECT avg(value) AS f FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 24)),
    {_STEPS}
    SELECT CAST(step AS INTEGER) AS step, last_ts + to_hours(CAST(step AS INTEGER)) AS ts, 'value' AS target,
           'moving_average' AS method, f AS forecast FROM s, m, steps
    """, doubles="forecast")  # fmt: skip
def _(t):
    return forecast.timeline(_events(t), "value", "moving_average", order=_ORDER)


# ---- autoregression --------------------------------------------------------------------------


def _fit_sql(table: str, key: str) -> str:
    """All six fits per series from its moments, then the one with the lowest AIC."""
    order = f"PARTITION BY {key} ORDER BY ts, event_id"
    terms = {"x": "value", "u": "l1", "z0": "value - l1", "z1": "l1 - l2", "z2": "l2 - l3"}
    sums = ["count(*) AS points", "count(*) FILTER (WHERE l3 IS NOT NULL) AS n"]
    sums += [f"avg({e}) FILTER (WHERE l3 IS NOT NULL) AS m_{n}" for n, e in terms.items()]
    for pair in ("x x", "u u", "u z0", "u z1", "z0 z0", "z0 z1", "z0 z2", "z1 z1", "z1 z2", "z2 z2"):
        a, b = pair.split()
        sums.append(f"covar_pop({terms[a]}, {terms[b]}) FILTER (WHERE l3 IS NOT NULL) AS {a}_{b}")

    def two(a: str, b: str, a0: str, b0: str) -> tuple[str, str]:
        det = f"({a}_{a} * {b}_{b} - {a}_{b} * {a}_{b})"
        return (f"(({a0} * {b}_{b} - {b0} * {a}_{b}) / {det})", f"(({b0} * {a}_{a} - {a0} * {a}_{b}) / {det})")

    g1 = "(u_z0 / u_u)"
    g2, h2 = two("u", "z1", "u_z0", "z0_z1")
    k1 = "(z0_z1 / z1_z1)"
    k2, q2 = two("z1", "z2", "z0_z1", "z0_z2")
    zero = "0.0::DOUBLE"
    models = [
        (0, 0, "m_x", zero, zero, "x_x"),
        (1, 0, f"m_z0 - {g1} * m_u", f"1 + {g1}", zero, f"z0_z0 - {g1} * u_z0"),
        (2, 0, f"m_z0 - {g2} * m_u - {h2} * m_z1", f"1 + {g2} + {h2}", f"-{h2}",
         f"z0_z0 - {g2} * u_z0 - {h2} * z0_z1"),
        (0, 1, "m_z0", zero, zero, "z0_z0"),
        (1, 1, f"m_z0 - {k1} * m_z1", k1, zero, f"z0_z0 - {k1} * z0_z1"),
        (2, 1, f"m_z0 - {k2} * m_z1 - {q2} * m_z2", k2, q2, f"z0_z0 - {k2} * z0_z1 - {q2} * z0_z2"),
    ]
    fits = " UNION ALL ".join(
        f"SELECT {key}, n, points, {p} AS p, {d} AS d, {const} AS const, {b1} AS b1, {b2} AS b2, {v} AS v "
        "FROM sums WHERE points >= 100"
        for p, d, const, b1, b2, v in models
    )
    return f"""
    lagged AS (SELECT {key}, ts, event_id, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2,
                      lag(value, 3) OVER w AS l3 FROM {table} WINDOW w AS ({order})),
    sums AS (SELECT {key}, {", ".join(sums)} FROM lagged GROUP BY 1),
    fits AS ({fits}),
    scored AS (SELECT {key}, n, points, p, d, const, b1, b2, n * v AS rss, n * ln(v) + 2 * (p + 1) AS aic FROM fits),
    best AS (SELECT {key}, n, points, aic, p, d, const, b1, b2, rss FROM scored
             QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY aic, p, d) = 1)
    """


_FIT_DOUBLES = "aic const b1 b2"


@both("autoregression_fit", f"WITH {_fit_sql('events', 'event_type')} SELECT * EXCLUDE (rss) FROM best",
      doubles=_FIT_DOUBLES, digits=5)
def _(t, layout):
    rows = t.events.select("event_id", "ts", "event_type", "value")
    return autoreg.fit_autoregression(
        rows, "value", keys=["event_type"], order=_ORDER, layout=layout
    ).drop("rss")


_RAMP = """ramp AS (SELECT event_type, ts, event_id,
    sum(value - 25) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value FROM events)"""


@query("autoregressive_forecast", f"""
    WITH RECURSIVE {_RAMP}, {_fit_sql('ramp', 'event_type')},
    ends AS (SELECT event_type, list(value ORDER BY ts, event_id) AS x FROM (
                 SELECT * FROM ramp QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3)
             GROUP BY 1),
    r AS (
        SELECT b.*, 0 AS step, CASE WHEN d = 1 THEN x[3] - x[2] ELSE x[3] END AS s1,
               CASE WHEN d = 1 THEN x[2] - x[1] ELSE x[2] END AS s2, x[3] AS lvl,
               1.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 1.0::DOUBLE AS cum, 0.0::DOUBLE AS var
        FROM best b JOIN ends USING (event_type)
        UNION ALL
        SELECT event_type, n, points, aic, p, d, const, b1, b2, rss, step + 1, const + b1 * s1 + b2 * s2, s1,
               CASE WHEN d = 1 THEN lvl + const + b1 * s1 + b2 * s2 ELSE const + b1 * s1 + b2 * s2 END,
               b1 * w1 + b2 * w2, w1, cum + b1 * w1 + b2 * w2,
               var + CASE WHEN d = 1 THEN cum * cum ELSE w1 * w1 END
        FROM r WHERE step < 24)
    SELECT event_type, step, lvl AS forecast, lvl - 1.959963984540054 * sqrt(var * rss / n) AS confidence_lower,
           lvl + 1.959963984540054 * sqrt(var * rss / n) AS confidence_upper
    FROM r WHERE step > 0
    """, doubles="forecast confidence_lower confidence_upper", digits=3)  # fmt: skip
def _(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_type").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = t.events.select("event_id", "ts", "event_type", F.sum(F.col("value") - 25).over(w).alias("value"))
    return autoreg.autoregressive_forecast(rows, "value", keys=["event_type"], order=_ORDER)


# ---- evaluation ------------------------------------------------------------------------------

_GROUPS = ["model_name", "target"]
_SCORES = """scored AS (
        SELECT *, actual - predicted AS e,
               sign(actual - lag(actual) OVER w) = sign(predicted - lag(predicted) OVER w) AS same
        FROM predictions WINDOW w AS (PARTITION BY model_name, target ORDER BY ts, event_id)),
    scores AS (
        SELECT model_name, target, count(*) AS n_samples, avg(abs(e)) AS mae, avg(e * e) AS mse,
               sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (count(*) * var_pop(actual)) AS r2,
               avg(abs(e / actual)) FILTER (WHERE actual <> 0) * 100 AS mape, max(abs(e)) AS max_error,
               median(abs(e)) AS median_absolute_error, avg(CAST(same AS DOUBLE)) * 100 AS directional_accuracy,
               sqrt(avg(e * e)) / (max(actual) - min(actual)) AS normalized_rmse,
               avg(abs(e)) / (max(actual) - min(actual)) AS normalized_mae,
               avg(actual) AS y_true_mean, stddev_pop(actual) AS y_true_std, avg(predicted) AS y_pred_mean,
               stddev_pop(predicted) AS y_pred_std, avg(e) AS residual_mean, stddev_pop(e) AS residual_std
        FROM scored GROUP BY 1, 2)"""
_SCORE_DOUBLES = " ".join([*evaluate.METRICS, *evaluate.STATISTICS])


def _scores(t, layout=AUTO):
    return evaluate.metrics(t.predictions, by=_GROUPS, order=_ORDER, layout=layout)


@both("forecast_metrics", f"WITH {_SCORES} SELECT * FROM scores", views="predictions", doubles=_SCORE_DOUBLES)
def _(t, layout):
    return _scores(t, layout)


@query("paired_forecasts", """
    SELECT a.event_id, a.value AS actual, b.value AS predicted FROM events a
    JOIN (SELECT event_id, ts, avg(value) OVER () AS value FROM events) b USING (event_id, ts)
    """, doubles="predicted")  # fmt: skip
def _(t):
    actual = t.events.select("event_id", "ts", c("value").alias("actual"))
    mean = t.events.agg(F.avg("value")).scalar()
    predicted = t.events.select("event_id", "ts", mean.alias("predicted"))
    return evaluate.paired(actual, predicted, ["event_id", "ts"]).drop("ts")


@query("model_ranking", f"""
    WITH {_SCORES}
    SELECT model_name, target, rmse, rank() OVER (PARTITION BY target ORDER BY rmse) AS rank FROM scores
    """, views="predictions", doubles="rmse")  # fmt: skip
def _(t):
    ranked = evaluate.rank_models(_scores(t), "rmse", by=["target"])
    return ranked.select("model_name", "target", "rmse", "rank")


@query("model_ranking_overall", f"""
    WITH {_SCORES} SELECT model_name, target, mape, rank() OVER (ORDER BY mape NULLS LAST) AS rank FROM scores
    """, views="predictions", doubles="mape")  # fmt: skip
def _(t):
    return evaluate.rank_models(_scores(t), "mape").select("model_name", "target", "mape", "rank")


@query("model_ranking_direction", f"""
    WITH {_SCORES}
    SELECT model_name, target, directional_accuracy,
           rank() OVER (PARTITION BY target ORDER BY directional_accuracy DESC) AS rank FROM scores
    """, views="predictions", doubles="directional_accuracy")  # fmt: skip
def _(t):
    ranked = evaluate.rank_models(_scores(t), "directional_accuracy", by=["target"])
    return ranked.select("model_name", "target", "directional_accuracy", "rank")


@query("best_model_per_target", f"""
    WITH {_SCORES}
    SELECT model_name, target, r2 FROM scores
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY r2 DESC NULLS LAST, model_name) = 1
    """, views="predictions", doubles="r2")  # fmt: skip
def _(t):
    best = evaluate.best_model(_scores(t), "r2", per_target=True)
    return best.select("model_name", "target", "r2")


@query("best_model", f"""
    WITH {_SCORES} SELECT model_name, target, mae FROM scores ORDER BY mae, model_name LIMIT 1
    """, views="predictions", doubles="mae")  # fmt: skip
def _(t):
    return evaluate.best_model(_scores(t), "mae").select("model_name", "target", "mae")


@both("residual_analysis", """
    WITH r AS (SELECT model_name, target, ts, event_id, actual - predicted AS e FROM predictions),
    l AS (SELECT *, lag(e) OVER (PARTITION BY model_name, target ORDER BY ts, event_id) AS b FROM r),
    a AS (SELECT model_name, target, count(e) AS n, avg(e) AS mean, stddev_pop(e) AS std, min(e) AS min, max(e) AS max,
                 skewness(e) AS skewness, kurtosis(e) AS kurtosis, corr(e, b) AS autocorrelation_lag1,
                 quantile_cont(e, 0.25) AS q25, median(e) AS median, quantile_cont(e, 0.75) AS q75
          FROM l GROUP BY 1, 2)
    SELECT *, abs(mean) < 0.1 * std AS is_centered, abs(skewness) < 0.5 AS is_symmetric,
           abs(autocorrelation_lag1) > 0.3 AS has_autocorrelation FROM a
    """, views="predictions",
    doubles="mean std min max skewness kurtosis autocorrelation_lag1 q25 median q75")
def _(t, layout):
    return evaluate.residual_analysis(t.predictions, by=_GROUPS, order=_ORDER, layout=layout)


_FOLD_BASE = """n AS (SELECT event_type, value, row_number() OVER w AS rn,
             count(*) OVER (PARTITION BY event_type) AS total
             FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    folds AS (SELECT DISTINCT event_type, total, unnest(generate_series(1, 5)) AS fold FROM n WHERE total - 120 >= 100),
    ends AS (SELECT *, total - (6 - fold) * 24 AS train_end FROM folds)"""
_FOLDS = f"""{_FOLD_BASE},
    preds AS (SELECT e.event_type, e.fold, e.train_end, avg(n.value) AS predicted
              FROM ends e JOIN n ON n.event_type = e.event_type AND n.rn BETWEEN e.train_end - 23 AND e.train_end
              GROUP BY 1, 2, 3),
    pairs AS (SELECT p.event_type, CAST(p.fold AS INTEGER) AS fold, CAST(n.rn - p.train_end AS INTEGER) AS step,
                     n.value AS actual, predicted
              FROM preds p JOIN n ON n.event_type = p.event_type AND n.rn BETWEEN p.train_end + 1 AND p.train_end + 24)"""
_FOLD_SCORES = """fold_scores AS (
        SELECT event_type, fold, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse,
               1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)) AS r2,
               avg(abs((actual - predicted) / actual)) FILTER (WHERE actual <> 0) * 100 AS mape
        FROM pairs GROUP BY 1, 2)"""
_TYPE = {"keys": ["event_type"], "order": _ORDER}


def _typed(t):
    return t.events.select("event_id", "ts", "event_type", "value")


def _folds(t, layout=AUTO):
    return evaluate.backtest_forecasts(
        _typed(t), "value", forecast.moving_average(), layout=layout, **_TYPE
    )


@both("backtest_forecasts", f"WITH {_FOLDS} SELECT * FROM pairs", doubles="actual predicted")
def _(t, layout):
    return _folds(t, layout)


@query("backtest_folds", f"WITH {_FOLDS}, {_FOLD_SCORES} SELECT * FROM fold_scores", doubles="mae rmse r2 mape")
def _(t):
    return evaluate.fold_scores(_folds(t), keys=["event_type"])


@query("backtest_summary", f"""
    WITH {_FOLDS}, {_FOLD_SCORES}
    SELECT event_type, count(*) AS n_splits, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std,
           avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std,
           avg(mape) AS mape_mean, stddev_pop(mape) AS mape_std
    FROM fold_scores GROUP BY 1
    """, doubles="mae_mean mae_std rmse_mean rmse_std r2_mean r2_std mape_mean mape_std")  # fmt: skip
def _(t):
    scores = evaluate.fold_scores(_folds(t), keys=["event_type"])
    return evaluate.backtest_summary(scores, keys=["event_type"])


def _plug_in(df, value, steps, *, keys, order, layout):
    return forecast.forecast(df, value, "moving_average", steps, keys=keys, order=order, layout=layout)


@both("backtest_plug_in", f"WITH {_FOLDS} SELECT * FROM pairs", doubles="actual predicted")
def _(t, layout):
    return evaluate.backtest_with(_typed(t), "value", _plug_in, layout=layout, **_TYPE)


@query("backtest_autoregressive", f"""
    WITH RECURSIVE {_FOLD_BASE},
    train AS (SELECT e.event_type || '/' || e.fold AS k, n.rn AS ts, 0 AS event_id, n.value
              FROM ends e JOIN n ON n.event_type = e.event_type AND n.rn <= e.train_end),
    {_fit_sql('train', 'k')},
    tail AS (SELECT k, list(value ORDER BY ts) AS x FROM (
                 SELECT * FROM train QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) <= 3) GROUP BY 1),
    r AS (
        SELECT b.k, const, b1, b2, d, 0 AS step, CASE WHEN d = 1 THEN x[3] - x[2] ELSE x[3] END AS s1,
               CASE WHEN d = 1 THEN x[2] - x[1] ELSE x[2] END AS s2, x[3] AS lvl
        FROM best b JOIN tail USING (k)
        UNION ALL
        SELECT k, const, b1, b2, d, step + 1, const + b1 * s1 + b2 * s2, s1,
               CASE WHEN d = 1 THEN lvl + const + b1 * s1 + b2 * s2 ELSE const + b1 * s1 + b2 * s2 END
        FROM r WHERE step < 24)
    SELECT e.event_type, CAST(e.fold AS INTEGER) AS fold, r.step, n.value AS actual, r.lvl AS predicted
    FROM r JOIN ends e ON r.k = e.event_type || '/' || e.fold
    JOIN n ON n.event_type = e.event_type AND n.rn = e.train_end + r.step
    WHERE r.step > 0
    """, doubles="actual predicted", digits=5)  # fmt: skip
def _(t):
    return autoreg.backtest_autoregression(_typed(t), "value", **_TYPE)


# ---- run catalogue ---------------------------------------------------------------------------


@query("find_runs", """
    SELECT model_id, model_name, created_at FROM runs
    WHERE model_type = 'ARIMA' AND target = 'NO2' AND list_has_any(tags, ['best', 'weekly'])
    """, views="runs")  # fmt: skip
def _(t):
    rows = catalog.find_runs(t.runs, model_type="ARIMA", target="NO2", tags=["best", "weekly"])
    return rows.select("model_id", "model_name", "created_at")


_LATEST = """latest AS (SELECT * FROM runs
    QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY CAST(split_part(version, '.', 3) AS BIGINT) DESC) = 1)"""


@query("latest_versions", f"WITH {_LATEST} SELECT model_name, model_id, version FROM latest", views="runs")
def _(t):
    return catalog.latest_versions(t.runs).select("model_name", "model_id", "version")


@query("next_versions", f"""
    WITH {_LATEST}
    SELECT model_name, '1.0.' || (CAST(split_part(version, '.', 3) AS BIGINT) + 1) AS next_version FROM latest
    """, views="runs")  # fmt: skip
def _(t):
    return catalog.next_version(t.runs)


@query("run_ids", """
    SELECT model_id, model_type || '_' || replace(model_name, ' ', '_') || '_' || strftime(created_at, '%Y%m%d_%H%M%S') AS run_id
    FROM runs
    """, views="runs")  # fmt: skip
def _(t):
    rid = catalog.run_id(c("model_type"), c("model_name"), c("created_at"))
    return t.runs.select("model_id", rid.alias("run_id"))


@query("forecast_gates", """
    SELECT user_id, count(value) AS rows, 24 AS required, count(value) >= 24 AS passed FROM events GROUP BY 1
    """)  # fmt: skip
def _(t):
    return row_gate(t.events, 24, keys=["user_id"], value="value")
