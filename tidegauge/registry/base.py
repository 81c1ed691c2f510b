"""How a named query is written down, and the views that queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import c, hour_start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Added before rounding so that a value half-way between two results rounds up in both engines.
_NUDGE = 1e-9


class Tables:
    """The given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def gaps(self) -> DataFrame:
        """Events with every seventh value missing."""
        value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
        return self.events.select("event_id", "ts", "user_id", "event_type", value.alias("value"))

    @cached_property
    def readings(self) -> DataFrame:
        """Hourly wide readings with natural gaps: mean value per event type, and covariates."""
        kind, value = F.col("event_type"), F.col("value")
        means = {"PM2.5": "click", "PM10": "view", "NO2": "purchase", "SO2": "signup", "CO": "error"}
        return self.events.groupBy(hour_start(F.col("ts")).alias("datetime")).agg(
            *[F.avg(F.when(kind == k, value)).alias(n) for n, k in means.items()],
            F.avg(value).alias("O3"),
            F.count(F.lit(1)).cast("double").alias("temperature"),
            F.countDistinct("user_id").cast("double").alias("humidity"),
            F.max(value).alias("pressure"),
            F.min(value).alias("wind_speed"),
            F.avg("user_id").alias("wind_direction"),
        )

    @cached_property
    def text_times(self) -> DataFrame:
        """Events whose time is text that sometimes does not parse, and whose value is text too."""
        bad = F.col("event_id") % 11 == 0
        stamp = F.when(bad, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        number = F.when(bad, F.lit("broken")).otherwise(F.col("value").cast("string"))
        return self.events.select("event_id", stamp.alias("datetime"), number.alias("value"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Two models' one-step predictions of every event value: the previous value, the mean of five."""
        from ..operators.order import over_rows

        value = F.col("value")
        rows = over_rows(
            self.events,
            lambda w: {
                "last_value": F.lag(value, 1).over(w),
                "mean_of_five": F.avg(value).over(w.rowsBetween(-5, -1)),
            },
            keys=["event_type"],
            order=["ts", "event_id"],
            before=5,
        )
        models = F.array(
            *[
                F.struct(F.lit(m).alias("model_name"), F.col(m).alias("predicted"))
                for m in ("last_value", "mean_of_five")
            ]
        )
        return rows.select(
            F.col("event_type").alias("target"), "ts", "event_id", value.alias("actual"), F.inline(models)
        ).where(F.col("predicted").isNotNull())

    @cached_property
    def runs(self) -> DataFrame:
        """A catalogue of model runs: one run per supplier, versions counted up per nation."""
        s = self.read("supplier")
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        return s.select(
            F.concat(F.lit("run_"), key.cast("string")).alias("model_id"),
            F.concat(F.lit("model "), nation.cast("string")).alias("model_name"),
            F.when(key % 2 == 0, F.lit("ARIMA")).otherwise(F.lit("LSTM")).alias("model_type"),
            F.concat(F.lit("1.0."), key.cast("string")).alias("version"),
            F.when(key % 3 == 0, F.lit("PM2.5")).otherwise(F.lit("NO2")).alias("target"),
            F.array_compact(
                F.array(
                    F.when(key % 2 == 0, F.lit("daily")),
                    F.when(key % 5 == 0, F.lit("best")),
                    F.lit("all"),
                )
            ).alias("tags"),
            (
                F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=key.cast("int"))
            ).alias("created_at"),
        )


# The same views as common table expressions.
VIEWS = {
    "gaps": """gaps AS (
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 7 <> 0 THEN value END AS value
        FROM events)""",
    "readings": """readings AS (
        SELECT date_trunc('hour', ts) AS datetime,
               avg(value) FILTER (WHERE event_type = 'click')    AS "PM2.5",
               avg(value) FILTER (WHERE event_type = 'view')     AS "PM10",
               avg(value) FILTER (WHERE event_type = 'purchase') AS "NO2",
               avg(value) FILTER (WHERE event_type = 'signup')   AS "SO2",
               avg(value) FILTER (WHERE event_type = 'error')    AS "CO",
               avg(value)                                        AS "O3",
               CAST(count(*) AS DOUBLE)                          AS temperature,
               CAST(count(DISTINCT user_id) AS DOUBLE)           AS humidity,
               max(value)                                        AS pressure,
               min(value)                                        AS wind_speed,
               avg(user_id)                                      AS wind_direction
        FROM events GROUP BY 1)""",
    "text_times": """text_times AS (
        SELECT event_id,
               CASE WHEN event_id % 11 = 0 THEN 'n/a'
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS datetime,
               CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE CAST(value AS VARCHAR) END AS value
        FROM events)""",
    "predictions": """stepped AS (
        SELECT event_type, ts, event_id, value,
               lag(value) OVER w AS last_value,
               avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean_of_five
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
      predictions AS (
        SELECT event_type AS target, ts, event_id, value AS actual,
               'last_value' AS model_name, last_value AS predicted
        FROM stepped WHERE last_value IS NOT NULL
        UNION ALL
        SELECT event_type, ts, event_id, value, 'mean_of_five', mean_of_five
        FROM stepped WHERE mean_of_five IS NOT NULL)""",
    "runs": """runs AS (
        SELECT 'run_' || s_suppkey AS model_id, 'model ' || s_nationkey AS model_name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'ARIMA' ELSE 'LSTM' END AS model_type,
               '1.0.' || s_suppkey AS version,
               CASE WHEN s_suppkey % 3 = 0 THEN 'PM2.5' ELSE 'NO2' END AS target,
               list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'daily' END,
                            CASE WHEN s_suppkey % 5 = 0 THEN 'best' END, 'all'],
                           lambda x: x IS NOT NULL) AS tags,
               TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey AS INTEGER)) AS created_at
        FROM supplier)""",
}


def with_views(sql: str, *views: str) -> str:
    """Put the named views in front of a statement, which may have its own WITH list."""
    if not views:
        return sql
    head = ",\n".join(VIEWS[v] for v in views)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head},\n{body.removeprefix(start)}"
    return f"WITH {head}\n{body}"


def _rounded_sql(sql: str, doubles: list[str], digits: int) -> str:
    if not doubles:
        return sql
    parts = []
    for d in doubles:
        x = f'CAST("{d}" AS DOUBLE)'
        parts.append(
            f'CASE WHEN NOT isnan({x}) THEN round({x} + {_NUDGE!r}, {digits}) + 0.0 END AS "{d}"'
        )
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS result"


def _rounded(df: DataFrame, doubles: list[str], digits: int) -> DataFrame:
    def tidy(name: str):
        x = c(name).cast("double")
        return F.when(~F.isnan(x), F.round(x + F.lit(_NUDGE), digits) + F.lit(0.0))

    return df.withColumns({d: tidy(d) for d in doubles}) if doubles else df


def query(
    name: str, sql: str | None = None, *, views: str = "", doubles: str = "", digits: int = 6
):
    """Register a query; ``doubles`` lists the columns to round on both sides."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query twice: {name}")
        columns = doubles.split()
        QUERIES[name] = lambda spark, folder: _rounded(fn(Tables(spark, folder)), columns, digits)
        if sql is not None:
            ORACLES[name] = _rounded_sql(with_views(sql, *views.split()), columns, digits)
        return fn

    return register
