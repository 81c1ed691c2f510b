"""Validation: one row per check with its value, severity and message."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import c, hours_between, present
from ..functions.rules import RANGES
from ..sources.readings import POLLUTANTS, TIME_FORMAT, parsed_time
from ..session import cut
from .duplicates import copy_counts
from .order import AUTO, Layout
from .quantiles import quantiles
from .windows import gap_hours

ISSUE, WARNING, OK = "issue", "warning", "ok"
_FIELDS = ("check", "column", "metric", "value", "severity", "message")


def _row(check: str, column: str | None, metric: str, value: Column, severity: Column, message: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        severity.alias("severity"),
        F.when(severity != OK, message).alias("message"),
    )


def _rows(frame: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return frame.select(F.inline(F.array(*rows)))


def _graded(*cases: tuple[Column, str]) -> Column:
    out = F.lit(OK)
    for cond, label in reversed(cases):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def _text(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


@dataclass(frozen=True)
class Check:
    """Aggregates over the table and the report rows made from their one-row result."""

    aggregates: dict[str, Column]
    rows: list[Column]


def _run(df: DataFrame, *checks: Check) -> DataFrame:
    """All checks in one pass: a single wide aggregate, unfolded into report rows."""
    aggregates = {n: e for check in checks for n, e in check.aggregates.items()}
    rows = [r for check in checks for r in check.rows]
    if not rows:
        return df.sparkSession.createDataFrame([], _schema())
    if not aggregates:
        aggregates = {"__none": F.lit(0)}
    wide = df.agg(*[e.alias(n) for n, e in aggregates.items()])
    return wide.select(F.inline(F.array_compact(F.array(*rows))))


def _schema_check(df: DataFrame, required: Sequence[str], ts: str, fmt: str) -> Check:
    missing = [n for n in [ts, *required] if n not in df.columns]
    bad = F.count_if(F.lit(False))
    if ts in df.columns and isinstance(df.schema[ts].dataType, T.StringType):
        bad = F.count_if(c(ts).isNotNull() & parsed_time(c(ts), fmt).isNull())
    n, unread = F.col("schema_n"), F.col("schema_bad")
    return Check(
        {"schema_n": F.count(F.lit(1)), "schema_bad": bad},
        [
            _row(
                "schema", None, "missing_columns", F.lit(len(missing)),
                F.lit(ISSUE if missing else OK),
                F.lit("Missing required columns: " + ", ".join(sorted(missing))),
            ),
            _row(
                "schema", ts, "unreadable_times", unread, _graded((unread > 0, ISSUE)),
                F.concat(F.lit("Invalid datetime format in "), _text(unread), F.lit(" rows")),
            ),
            _row("schema", None, "rows", n, _graded((n == 0, ISSUE)), F.lit("DataFrame is empty")),
        ],
    )


def check_schema(
    df: DataFrame, required: Sequence[str] = tuple(POLLUTANTS), ts: str = "datetime", fmt: str = TIME_FORMAT
) -> DataFrame:
    """Missing columns, unreadable times, an empty table."""
    return _run(df, _schema_check(df, required, ts, fmt))


def _dataset_check(df: DataFrame) -> Check:
    return Check(
        {"dataset_n": F.count(F.lit(1))},
        [
            _row("dataset", None, "total_rows", F.col("dataset_n"), F.lit(OK), F.lit("")),
            _row("dataset", None, "total_columns", F.lit(len(df.columns)), F.lit(OK), F.lit("")),
        ],
    )


def _time_check(column: str, ts: str) -> Check:
    """First and last time in seconds since 1970 and the whole days between them."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    first, last = F.col("time_first"), F.col("time_last")
    days = F.floor(hours_between(last, first) / 24)
    metrics = {"start": hours_between(first, epoch) * 3600, "end": hours_between(last, epoch) * 3600, "duration_days": days}
    rows = [_row("time_range", column, m, e, F.lit(OK), F.lit("")) for m, e in metrics.items()]
    return Check(
        {"time_first": F.min(c(ts)).cast("timestamp_ntz"), "time_last": F.max(c(ts)).cast("timestamp_ntz")},
        [F.when(first.isNotNull(), r) for r in rows],
    )


def _missing_check(df: DataFrame) -> Check:
    aggregates, rows = {"missing_n": F.count(F.lit(1))}, []
    for i, v in enumerate(df.columns):
        aggregates[f"missing_{i}"] = F.count_if(c(v).isNull())
        m = F.col(f"missing_{i}")
        pct = _percent(m, F.col("missing_n"))
        grade = _graded((pct > 50, ISSUE), (pct > 20, WARNING))
        note = F.concat(
            F.lit(f"Column {v} has "), F.format_string("%.1f", pct), F.lit("% missing values")
        )
        rows.append(_row("missing", v, "count", m, F.lit(OK), F.lit("")))
        rows.append(_row("missing", v, "percent", pct, grade, note))
    return Check(aggregates, rows)


def check_missing(df: DataFrame) -> DataFrame:
    """Missing values per column; above half an issue, above a fifth a warning."""
    return _run(df, _missing_check(df))


def check_duplicates(df: DataFrame) -> DataFrame:
    """Extra copies of whole rows."""
    rows, copies = copy_counts(df)
    totals = df.sparkSession.createDataFrame([(rows, copies)], "n bigint, d bigint")
    d = F.col("d")
    note = F.concat(F.lit("Found "), _text(d), F.lit(" duplicate records"))
    return _rows(
        totals,
        [
            _row("duplicates", None, "count", d, _graded((d > 0, WARNING)), note),
            _row("duplicates", None, "percent", _percent(d, F.col("n")), F.lit(OK), F.lit("")),
        ],
    )


def time_range(df: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time and the whole days between them."""
    out = df.groupBy(*[c(k) for k in keys]).agg(F.min(c(ts)).alias("start"), F.max(c(ts)).alias("end"))
    days = F.floor(hours_between(F.col("end"), F.col("start")) / 24)
    return out.withColumn("duration_days", days)


def large_gaps(
    df: DataFrame,
    ts: str,
    hours: float = 24,
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """Rows that come more than ``hours`` after the row before, with that gap."""
    gaps = gap_hours(df, ts, keys=keys, tie=tie, layout=layout)
    return gaps.where(F.col("gap_hours") > hours)


def _gaps(df: DataFrame, ts: str, keys: Sequence[str], tie: Sequence[str], layout: Layout) -> DataFrame:
    """The hours between neighbouring rows, as one narrow column."""
    narrow = df.select(*[c(n) for n in dict.fromkeys([*keys, ts, *tie])]).where(c(ts).isNotNull())
    gaps = gap_hours(narrow, ts, keys=keys, tie=tie, layout=layout)
    return gaps.where(F.col("gap_hours").isNotNull()).select("gap_hours")


def _gap_check(ts: str, hours: float = 24) -> Check:
    g = F.col("large_gaps")
    note = F.concat(F.lit("Found "), _text(g), F.lit(f" gaps larger than {hours:g} hours in data"))
    return Check(
        {"large_gaps": F.count_if(F.col("gap_hours") > hours)},
        [_row("gaps", ts, "large_gaps", g, _graded((g > 0, WARNING)), note)],
    )


def check_gaps(
    df: DataFrame,
    ts: str,
    hours: float = 24,
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    return _run(_gaps(df, ts, keys, tie, layout), _gap_check(ts, hours))


def _range_check(df: DataFrame, ranges: Mapping[str, tuple]) -> Check:
    aggregates, rows = {}, []
    for i, v in enumerate(present(df, ranges)):
        low, high, unit = ranges[v]
        aggregates[f"range_n{i}"] = F.count(c(v))
        for kind, cond, bound, word, grade in (
            ("below_min", c(v) < low, low, "below minimum", ISSUE),
            ("above_max", c(v) > high, high, "above maximum", WARNING),
        ):
            aggregates[f"{kind}{i}"] = F.count_if(cond)
            k = F.col(f"{kind}{i}")
            note = F.concat(F.lit(f"{v}: "), _text(k), F.lit(f" values {word} ({bound} {unit})"))
            entry = _row("range", v, kind, k, _graded((k > 0, grade)), note)
            rows.append(F.when(F.col(f"range_n{i}") > 0, entry))
    return Check(aggregates, rows)


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple] = RANGES) -> DataFrame:
    """Values below the plausible minimum (issue) or above the maximum (warning)."""
    return _run(df, _range_check(df, ranges))


def _repeat_check(ts: str, extra: Column) -> Check:
    d = F.col("repeated_times")
    note = F.concat(F.lit("Found "), _text(d), F.lit(" duplicate timestamps"))
    return Check(
        {"repeated_times": extra},
        [_row("duplicate_times", ts, "count", d, _graded((d > 0, ISSUE)), note)],
    )


def check_duplicate_times(df: DataFrame, ts: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Extra rows with a timestamp that the series already has; rows without one are no repeats."""
    stamps = df.where(c(ts).isNotNull()).groupBy(*[c(k) for k in keys], c(ts)).agg(F.count(F.lit(1)).alias("__k"))
    return _run(stamps, _repeat_check(ts, F.coalesce(F.sum(F.col("__k") - 1), F.lit(0))))


def _median_gap(gaps: DataFrame, layout: Layout) -> float:
    """One number; it goes into the next pass as a literal. NaN without any gap."""
    whole = replace(layout, how="auto", largest=None, total=None) if layout.how == "grouped" else layout
    row = quantiles(gaps, ["gap_hours"], [0.5], layout=whole).first()
    return float("nan") if row is None or row["quantile"] is None else row["quantile"]


def _interval_aggregates(middle: float) -> dict[str, Column]:
    g = F.col("gap_hours")
    return {
        "gaps": F.count(g),
        "min_hours": F.min(g),
        "max_hours": F.max(g),
        "median_hours": F.max(F.lit(middle)),
        "std_hours": F.stddev_samp(g),
        "irregular": F.count_if(F.abs(g - F.lit(middle)) > F.lit(0.5 * middle)),
    }


def interval_stats(
    df: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """Shortest, longest, median and deviation of the gaps, and how many are irregular.

    A gap is irregular if it differs from the median by more than half of the median.
    """
    gaps = cut(_gaps(df, ts, keys, tie, layout), "gaps")
    found = _interval_aggregates(_median_gap(gaps, layout))
    return gaps.agg(*[e.alias(n) for n, e in found.items()]).where(F.col("gaps") > 0)


def _interval_check(ts: str, middle: float, share: float = 0.1) -> Check:
    odd = _graded((F.col("irregular") > F.col("gaps") * share, WARNING))
    note = F.lit("Highly irregular time intervals detected")
    rows = [
        _row("intervals", ts, n, F.col(n), F.lit(OK), F.lit(""))
        for n in ("min_hours", "max_hours", "median_hours", "std_hours")
    ]
    rows.append(_row("intervals", ts, "irregular", F.col("irregular"), odd, note))
    return Check(_interval_aggregates(middle), [F.when(F.col("gaps") > 0, r) for r in rows])


def check_intervals(
    df: DataFrame,
    ts: str,
    share: float = 0.1,
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """Interval statistics as checks; too many irregular gaps are a warning."""
    gaps = cut(_gaps(df, ts, keys, tie, layout), "gaps")
    return _run(gaps, _interval_check(ts, _median_gap(gaps, layout), share))


def _expected_rows(first: Column, last: Column) -> Column:
    return hours_between(last, first) + 1


def completeness(df: DataFrame, ts: str, *, keys: Sequence[str] = (), more_than: int = 24) -> DataFrame:
    """Rows against the hours between first and last, for series of more than a day of rows."""
    out = df.groupBy(*[c(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("actual_records"), F.min(c(ts)).alias("__a"), F.max(c(ts)).alias("__b")
    )
    expected = _expected_rows(F.col("__a"), F.col("__b"))
    return out.where(F.col("actual_records") > more_than).select(
        *[c(k) for k in keys],
        F.floor(expected).alias("expected_records"),
        "actual_records",
        (F.col("actual_records") / expected).alias("completeness_ratio"),
    )


def _completeness_check(
    column: str, rows: Column, expected: Column, minimum: float = 0.8, more_than: int = 24
) -> Check:
    n = F.col("complete_n")
    ratio = n / F.col("complete_expected")
    note = F.concat(
        F.lit("Data completeness is only "), F.format_string("%.1f", ratio * 100), F.lit("%")
    )
    entry = _row("completeness", column, "ratio", ratio, _graded((ratio < minimum, WARNING)), note)
    return Check({"complete_n": rows, "complete_expected": expected}, [F.when(n > more_than, entry)])


def _complete_table(column: str, ts: str, minimum: float = 0.8) -> Check:
    """Completeness of one series, over its rows."""
    expected = _expected_rows(F.min(c(ts)), F.max(c(ts)))
    return _completeness_check(column, F.count(F.lit(1)), expected, minimum)


def _complete_keys(column: str, minimum: float = 0.8) -> Check:
    """Completeness of many series, over their ``completeness`` rows."""
    rows, expected = F.sum("actual_records"), F.sum("expected_records")
    return _completeness_check(column, rows, expected, minimum)


def check_completeness(
    df: DataFrame, ts: str, minimum: float = 0.8, *, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows against the hours covered; with keys, over all series of more than a day of rows."""
    if keys:
        return _run(completeness(df, ts, keys=keys), _complete_keys(ts, minimum))
    return _run(df, _complete_table(ts, ts, minimum))


def validate(
    df: DataFrame,
    ts: str = "datetime",
    *,
    required: Sequence[str] = tuple(POLLUTANTS),
    ranges: Mapping[str, tuple] = RANGES,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    fmt: str = TIME_FORMAT,
    layout: Layout = AUTO,
) -> DataFrame:
    """Every check as one tidy table, in three passes over the data (four with keys).

    Besides the checks it tells the table's rows and columns and the time it covers.

    One wide aggregate covers schema, missing values, ranges and completeness; one hash count
    finds copies of rows; one ordering of the time column alone gives gaps, intervals and repeated
    timestamps (a gap of zero).
    """
    # Written once: every pass below reads this copy, whatever the table stands on.
    df = cut(df, "validated")
    checks = [_schema_check(df, required, ts, fmt), _dataset_check(df), _missing_check(df), _range_check(df, ranges)]
    timed = df
    if ts in df.columns:
        if isinstance(df.schema[ts].dataType, T.StringType):
            timed = df.withColumn("__ts", parsed_time(c(ts), fmt))
        else:
            timed = df.withColumn("__ts", c(ts))
        checks.append(_time_check(ts, "__ts"))
        if not keys:
            checks.append(_complete_table(ts, "__ts"))
    report = _run(timed, *checks).unionByName(check_duplicates(df))
    if ts not in df.columns:
        return report
    if keys:
        series = completeness(timed.where(F.col("__ts").isNotNull()), "__ts", keys=keys)
        report = report.unionByName(_run(series, _complete_keys(ts)))
    gaps = cut(_gaps(timed, "__ts", keys, tie, layout), "gaps")
    over_gaps = [
        _gap_check(ts),
        _repeat_check(ts, F.count_if(F.col("gap_hours") == 0)),
        _interval_check(ts, _median_gap(gaps, layout)),
    ]
    return report.unionByName(_run(gaps, *over_gaps))


def verdict(report: DataFrame) -> DataFrame:
    """Counts of issues and warnings, and whether the data may be processed."""
    issues = F.count_if(F.col("severity") == ISSUE)
    return report.agg(
        issues.alias("issues_count"),
        F.count_if(F.col("severity") == WARNING).alias("warnings_count"),
        (issues == 0).alias("valid"),
        (issues > 0).alias("has_critical_issues"),
    )


def report_text(report: DataFrame) -> DataFrame:
    """The report as one readable text; it holds a few rows per column, never data rows."""
    line = F.concat(F.upper("severity"), F.lit(": "), F.col("message"))
    absent = (F.col("check") == "missing") & (F.col("metric") == "count") & (F.col("value") > 0)
    gap = F.struct(F.col("column").alias("o"), F.concat(F.lit("  "), "column", F.lit(": "), _text(F.col("value"))).alias("l"))
    ranked = F.struct(F.when(F.col("severity") == ISSUE, 0).otherwise(1).alias("o"), line.alias("l"))
    counts = report.agg(
        F.count_if(F.col("severity") == ISSUE).alias("i"),
        F.count_if(F.col("severity") == WARNING).alias("w"),
        F.sort_array(F.collect_list(F.when(F.col("severity") != OK, ranked))).alias("lines"),
        F.sort_array(F.collect_list(F.when(absent, gap))).alias("gaps"),
    )
    head = F.concat(
        F.lit("DATA VALIDATION REPORT\nSTATUS: "),
        F.when(F.col("i") == 0, F.lit("VALID")).otherwise(F.lit("INVALID")),
        F.lit("\nIssues: "),
        F.col("i").cast("string"),
        F.lit("\nWarnings: "),
        F.col("w").cast("string"),
    )
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x["l"])), "")
    missing = F.array_join(F.transform("gaps", lambda x: F.concat(F.lit("\n"), x["l"])), "")
    missing = F.when(F.size("gaps") > 0, F.concat(F.lit("\nMissing values:"), missing)).otherwise(F.lit(""))
    return counts.select(F.concat(head, body, missing).alias("report"))


def row_gate(
    df: DataFrame, minimum: int = 200, *, keys: Sequence[str] = (), value: str | None = None
) -> DataFrame:
    """Whether each series has enough rows (non-null values when ``value`` is given)."""
    n = F.count(c(value)) if value else F.count(F.lit(1))
    return df.groupBy(*[c(k) for k in keys]).agg(n.alias("rows")).withColumns(
        {"required": F.lit(minimum), "passed": F.col("rows") >= minimum}
    )


def _schema() -> T.StructType:
    kinds = {"value": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in _FIELDS])
