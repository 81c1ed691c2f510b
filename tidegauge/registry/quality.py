"""Validation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import RANGES
from ..operators import quality
from ..operators.order import Layout
from .base import query

_POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]
_ROW = """'{check}' AS "check", {column} AS "column", '{metric}' AS metric, CAST({value} AS DOUBLE) AS value,
    {severity} AS severity, CASE WHEN {severity} <> 'ok' THEN {message} END AS message"""


def row(check, column, metric, value, severity="'ok'", message="''") -> str:
    name = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    return _ROW.format(
        check=check, column=name, metric=metric, value=value, severity=severity, message=message
    )


_BAD = "count(*) FILTER (WHERE TRY_CAST(datetime AS TIMESTAMP) IS NULL)"
_SCHEMA = " UNION ALL ".join(
    [
        f"""SELECT {row("schema", None, "missing_columns", "5", "'issue'",
            "'Missing required columns: CO, NO2, O3, PM10, PM2.5'")}""",
        f"""SELECT {row("schema", "datetime", "unreadable_times", _BAD,
            f"CASE WHEN {_BAD} > 0 THEN 'issue' ELSE 'ok' END",
            f"'Invalid datetime format in ' || {_BAD} || ' rows'")} FROM text_times""",
        f"""SELECT {row("schema", None, "rows", "count(*)")} FROM text_times""",
    ]
)


@query("check_schema", _SCHEMA, views="text_times", doubles="value")
def _(t):
    rows = t.text_times.withColumnRenamed("value", "SO2")
    return quality.check_schema(rows, _POLLUTANTS)


def _missing_sql(table: str, columns: list[str], bounds=(50, 20)) -> str:
    parts = []
    for v in columns:
        m = f'(count(*) - count("{v}"))'
        pct = f"({m} * 100.0::DOUBLE / count(*))"
        grade = f"CASE WHEN {pct} > 50 THEN 'issue' WHEN {pct} > 20 THEN 'warning' ELSE 'ok' END"
        note = f"format('Column {v} has {{:.1f}}% missing values', {pct})"
        parts.append(f"SELECT {row('missing', v, 'count', m)} FROM {table}")
        parts.append(f"SELECT {row('missing', v, 'percent', pct, grade, note)} FROM {table}")
    return " UNION ALL ".join(parts)


_GAP_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@query("check_missing", _missing_sql("gaps", _GAP_COLUMNS), views="gaps", doubles="value")
def _(t):
    return quality.check_missing(t.gaps)


_HALF = """half AS (
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a,
           CASE WHEN event_id % 4 <> 0 THEN value END AS b FROM events)"""


@query("check_missing_severe", f"WITH {_HALF} {_missing_sql('half', ['event_id', 'a', 'b'])}", doubles="value")
def _(t):
    key, value = F.col("event_id"), F.col("value")
    rows = t.events.select(
        "event_id", F.when(key % 3 == 0, value).alias("a"), F.when(key % 4 != 0, value).alias("b")
    )
    return quality.check_missing(rows)


def _duplicates_sql(table: str, columns: str) -> str:
    d = f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table})))"
    grade = f"CASE WHEN {d} > 0 THEN 'warning' ELSE 'ok' END"
    note = f"'Found ' || {d} || ' duplicate records'"
    return (
        f"SELECT {row('duplicates', None, 'count', d, grade, note)} FROM {table} UNION ALL "
        f"SELECT {row('duplicates', None, 'percent', f'{d} * 100.0::DOUBLE / count(*)')} FROM {table}"
    )


@query("check_duplicates", _duplicates_sql("lineitem", "*"), doubles="value")
def _(t):
    """Whole rows of the largest table, which has few copies if any."""
    return quality.check_duplicates(t.lineitem)


@query("check_duplicates_found", _duplicates_sql("orders", "o_orderstatus, o_orderdate"), doubles="value")
def _(t):
    """Two columns of all rows, where most are copies."""
    return quality.check_duplicates(t.orders.select("o_orderstatus", "o_orderdate"))


@query("time_range", """
    SELECT min(ts) AS start, max(ts) AS "end",
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10::DOUBLE) AS BIGINT) AS duration_days
    FROM events
    """)  # fmt: skip
def _(t):
    return quality.time_range(t.events, "ts")


_GAPS = """
    SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9::DOUBLE AS gap_hours
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """


@query("large_gaps", f"SELECT * FROM ({_GAPS}) g WHERE gap_hours > 24", doubles="gap_hours")
def _(t):
    rows = quality.large_gaps(t.events, "ts", keys=["user_id"], tie=["event_id"])
    return rows.select("user_id", "event_id", "gap_hours")


_LARGE = f"(SELECT count(*) FROM ({_GAPS}) g WHERE gap_hours > 24)"


@query("check_gaps", f"""
    SELECT {row("gaps", "ts", "large_gaps", _LARGE, f"CASE WHEN {_LARGE} > 0 THEN 'warning' ELSE 'ok' END",
                f"'Found ' || {_LARGE} || ' gaps larger than 24 hours in data'")}
    """, doubles="value")  # fmt: skip
def _(t):
    return quality.check_gaps(t.events, "ts", keys=["user_id"], tie=["event_id"])


_RANGES = {"l_quantity": (5, 45, "pieces"), "l_discount": (0, 0.08, "share"), "l_tax": (0, 1, "share")}


def _ranges_sql() -> str:
    parts = []
    for v, (low, high, unit) in _RANGES.items():
        for metric, cond, word, bound, grade in (
            ("below_min", f"{v} < {low}", "below minimum", low, "issue"),
            ("above_max", f"{v} > {high}::DOUBLE", "above maximum", high, "warning"),
        ):
            k = f"count(*) FILTER (WHERE {cond})"
            severity = f"CASE WHEN {k} > 0 THEN '{grade}' ELSE 'ok' END"
            note = f"'{v}: ' || {k} || ' values {word} ({bound} {unit})'"
            parts.append(f"SELECT {row('range', v, metric, k, severity, note)} FROM lineitem")
    return " UNION ALL ".join(parts)


@query("check_ranges", _ranges_sql(), doubles="value")
def _(t):
    return quality.check_ranges(t.lineitem, _RANGES)


_DUP_TS = "(count(*) - count(DISTINCT o_orderdate))"


@query("check_duplicate_times", f"""
    SELECT {row("duplicate_times", "o_orderdate", "count", _DUP_TS,
                f"CASE WHEN {_DUP_TS} > 0 THEN 'issue' ELSE 'ok' END",
                f"'Found ' || {_DUP_TS} || ' duplicate timestamps'")}
    FROM orders
    """, doubles="value")  # fmt: skip
def _(t):
    return quality.check_duplicate_times(t.orders, "o_orderdate")


_INTERVALS = """
    WITH g AS (SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 3.6e9::DOUBLE AS h FROM events),
    m AS (SELECT median(h) AS med FROM g)
    SELECT count(h) AS gaps, min(h) AS min_hours, max(h) AS max_hours, any_value(med) AS median_hours,
           stddev_samp(h) AS std_hours, count(*) FILTER (WHERE abs(h - med) > 0.5::DOUBLE * med) AS irregular
    FROM g, m WHERE h IS NOT NULL
    """
_HOURS = "min_hours max_hours median_hours std_hours"


@query("interval_stats", _INTERVALS, doubles=_HOURS)
def _(t):
    return quality.interval_stats(t.events, "ts", tie=["event_id"])


@query("interval_stats_sliced", _INTERVALS, doubles=_HOURS)
def _(t):
    how = Layout("sliced", limit=1_000, slice_rows=1_000)
    return quality.interval_stats(t.events, "ts", tie=["event_id"], layout=how)


@query("completeness", """
    SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE + 1) AS BIGINT) AS expected_records,
           count(*) AS actual_records,
           count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE + 1) AS completeness_ratio
    FROM events GROUP BY 1 HAVING count(*) > 24
    """, doubles="completeness_ratio")  # fmt: skip
def _(t):
    return quality.completeness(t.events, "ts", keys=["user_id"])


_NAMES = list(RANGES)
_SPAN = {
    "start": "epoch_us(min(datetime)) / 1e6::DOUBLE",
    "end": "epoch_us(max(datetime)) / 1e6::DOUBLE",
    "duration_days": "floor((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 8.64e10::DOUBLE)",
}


def _report_sql() -> str:
    parts = [
        f"SELECT {row('schema', None, 'missing_columns', '0')}",
        f"SELECT {row('schema', 'datetime', 'unreadable_times', '0')}",
        f"SELECT {row('schema', None, 'rows', 'count(*)')} FROM readings",
        f"SELECT {row('dataset', None, 'total_rows', 'count(*)')} FROM readings",
        f"SELECT {row('dataset', None, 'total_columns', str(len(_NAMES) + 1))}",
        *[f"SELECT {row('time_range', 'datetime', m, e)} FROM readings" for m, e in _SPAN.items()],
        _missing_sql("readings", ["datetime", *_NAMES]),
        _duplicates_sql("readings", "*"),
    ]
    for v, (low, high, unit) in RANGES.items():
        for metric, cond, word, bound, grade in (
            ("below_min", f'"{v}" < {low}', "below minimum", low, "issue"),
            ("above_max", f'"{v}" > {high}', "above maximum", high, "warning"),
        ):
            k = f"count(*) FILTER (WHERE {cond})"
            severity = f"CASE WHEN {k} > 0 THEN '{grade}' ELSE 'ok' END"
            note = f"'{v}: ' || {k} || ' values {word} ({bound} {unit})'"
            parts.append(f"SELECT {row('range', v, metric, k, severity, note)} FROM readings")
    big = "count(*) FILTER (WHERE h > 24)"
    parts.append(
        f"""SELECT {row("gaps", "datetime", "large_gaps", big,
            f"CASE WHEN {big} > 0 THEN 'warning' ELSE 'ok' END",
            f"'Found ' || {big} || ' gaps larger than 24 hours in data'")} FROM g"""
    )
    parts.append(f"SELECT {row('duplicate_times', 'datetime', 'count', 'count(*) - count(DISTINCT datetime)')} FROM readings")
    for metric, e in (
        ("min_hours", "min(h)"),
        ("max_hours", "max(h)"),
        ("median_hours", "median(h)"),
        ("std_hours", "stddev_samp(h)"),
    ):
        parts.append(f"SELECT {row('intervals', 'datetime', metric, e)} FROM g")
    odd = "count(*) FILTER (WHERE abs(h - (SELECT median(h) FROM g)) > 0.5 * (SELECT median(h) FROM g))"
    grade = f"CASE WHEN {odd} > count(h) * 0.1 THEN 'warning' ELSE 'ok' END"
    parts.append(
        f"""SELECT {row("intervals", "datetime", "irregular", odd, grade,
            "'Highly irregular time intervals detected'")} FROM g"""
    )
    ratio = "count(*) / ((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 3.6e9::DOUBLE + 1)"
    grade = f"CASE WHEN {ratio} < 0.8 THEN 'warning' ELSE 'ok' END"
    note = f"format('Data completeness is only {{:.1f}}%', {ratio} * 100)"
    parts.append(f"SELECT {row('completeness', 'datetime', 'ratio', ratio, grade, note)} FROM readings")
    gaps = """g AS (SELECT (epoch_us(datetime) - lag(epoch_us(datetime)) OVER (ORDER BY datetime))
                    / 3.6e9::DOUBLE AS h FROM readings)"""
    return f"WITH {gaps}, report AS (" + " UNION ALL ".join(parts) + ")\n"


_REPORT = _report_sql()


def _report(t):
    return quality.validate(t.readings)


@query("validation_report", _REPORT + "SELECT * FROM report", views="readings", doubles="value")
def _(t):
    return _report(t)


@query("validation_verdict", _REPORT + """
    SELECT count(*) FILTER (WHERE severity = 'issue') AS issues_count,
           count(*) FILTER (WHERE severity = 'warning') AS warnings_count,
           count(*) FILTER (WHERE severity = 'issue') = 0 AS valid,
           count(*) FILTER (WHERE severity = 'issue') > 0 AS has_critical_issues
    FROM report
    """, views="readings")  # fmt: skip
def _(t):
    return quality.verdict(_report(t))


@query("validation_text", _REPORT + """
    SELECT 'DATA VALIDATION REPORT' || chr(10) || 'STATUS: '
        || CASE WHEN count(*) FILTER (WHERE severity = 'issue') = 0 THEN 'VALID' ELSE 'INVALID' END
        || chr(10) || 'Issues: ' || count(*) FILTER (WHERE severity = 'issue')
        || chr(10) || 'Warnings: ' || count(*) FILTER (WHERE severity = 'warning')
        || coalesce(string_agg(chr(10) || upper(severity) || ': ' || message, ''
               ORDER BY severity, upper(severity) || ': ' || message) FILTER (WHERE severity <> 'ok'), '')
        || coalesce(chr(10) || 'Missing values:' || string_agg(
               chr(10) || '  ' || "column" || ': ' || CAST(value AS BIGINT), '' ORDER BY "column")
               FILTER (WHERE "check" = 'missing' AND metric = 'count' AND value > 0), '') AS report
    FROM report
    """, views="readings")  # fmt: skip
def _(t):
    return quality.report_text(_report(t))


@query("row_gate", """
    SELECT user_id, count(value) AS rows, 60 AS required, count(value) >= 60 AS passed FROM gaps GROUP BY 1
    """, views="gaps")  # fmt: skip
def _(t):
    return quality.row_gate(t.gaps, 60, keys=["user_id"], value="value")
