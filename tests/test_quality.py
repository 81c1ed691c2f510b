from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidegauge.operators import profiles, quality
from tidegauge.operators.duplicates import copy_counts
from tidegauge.operators.order import Layout


def found(report):
    return {(r["check"], r["column"], r["metric"]): r for r in report.collect()}


def test_gaps_intervals_and_completeness(series):
    t = [datetime(2024, 1, 1)]
    for step in [1, 1, 30, 1, 1, 48, 1] + [1] * 20:
        t.append(t[-1] + timedelta(hours=step))
    df = series([1.0] * len(t), t)
    for layout in (Layout(), Layout("sliced", slice_rows=4, limit=4)):
        rows = found(quality.check_gaps(df, "ts", layout=layout))
        assert rows["gaps", "ts", "large_gaps"]["value"] == 2
        assert rows["gaps", "ts", "large_gaps"]["message"] == "Found 2 gaps larger than 24 hours in data"
        stats = quality.interval_stats(df, "ts", layout=layout).first()
        assert (stats["gaps"], stats["min_hours"], stats["max_hours"], stats["median_hours"]) == (27, 1, 48, 1)
        assert stats["irregular"] == 2
    assert quality.large_gaps(df, "ts").count() == 2
    row = quality.completeness(df, "ts").first()
    assert (row["expected_records"], row["actual_records"]) == (104, 28)
    assert found(quality.check_completeness(df, "ts"))["completeness", "ts", "ratio"]["severity"] == "warning"
    assert quality.completeness(df.limit(24), "ts").count() == 0
    assert quality.time_range(df, "ts").first()["duration_days"] == 4


def test_copies_are_compared_in_full(spark):
    rows = [(1, None), (None, 1), (1, None), (2, 2), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert copy_counts(df) == (6, 3)
    assert copy_counts(df.distinct()) == (3, 0)
    assert copy_counts(df.limit(0)) == (0, 0)
    got = found(quality.check_duplicates(df))
    assert got["duplicates", None, "count"]["value"] == 3
    assert got["duplicates", None, "percent"]["value"] == 50


def test_ranges_skip_columns_without_values(spark):
    df = spark.createDataFrame([(-1.0, None, 70.0), (600.0, None, 5.0)], "`PM2.5` double, NO2 double, temperature double")
    got = found(quality.check_ranges(df))
    assert got["range", "PM2.5", "below_min"]["severity"] == "issue"
    assert got["range", "PM2.5", "above_max"]["message"] == "PM2.5: 1 values above maximum (500 μg/m³)"
    assert got["range", "temperature", "above_max"]["severity"] == "warning"
    assert not any(c == "NO2" for _, c, _ in got)
    assert quality.check_ranges(df.select("NO2").withColumnRenamed("NO2", "other")).count() == 0


def test_schema_of_an_empty_table(spark):
    df = spark.createDataFrame([], "datetime string, `PM2.5` double")
    got = found(quality.check_schema(df))
    assert got["schema", None, "missing_columns"]["value"] == 5
    assert got["schema", None, "rows"]["severity"] == "issue"
    assert got["schema", "datetime", "unreadable_times"]["severity"] == "ok"


@pytest.mark.parametrize("layout", [Layout(), Layout("sliced", slice_rows=5, limit=5)], ids=["plain", "sliced"])
def test_whole_report(spark, layout):
    start = datetime(2024, 1, 1)
    rows = [((start + timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S"), 10.0, 1.0) for i in range(30)]
    rows += [rows[0], ("bad", 10.0, 1.0)]
    df = spark.createDataFrame(rows, "datetime string, `PM2.5` double, PM10 double")
    report = quality.validate(df, required=["PM2.5", "PM10"], layout=layout)
    got = found(report)
    assert got["schema", "datetime", "unreadable_times"]["value"] == 1
    assert got["duplicate_times", "datetime", "count"]["value"] == 1
    assert got["duplicates", None, "count"]["value"] == 1
    assert got["completeness", "datetime", "ratio"]["severity"] == "ok"
    verdict = quality.verdict(report).first()
    assert tuple(verdict) == (2, 1, False, True)
    text = quality.report_text(report).first()["report"]
    assert text.splitlines()[:4] == ["DATA VALIDATION REPORT", "STATUS: INVALID", "Issues: 2", "Warnings: 1"]
    assert "ISSUE: Found 1 duplicate timestamps" in text and "WARNING: Found 1 duplicate records" in text


def test_clean_data_is_valid(series):
    report = quality.validate(series([10.0] * 30), "ts", required=["x"])
    assert tuple(quality.verdict(report).first()) == (0, 0, True, False)


def test_no_time_column(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    report = quality.validate(df, required=[])
    assert quality.verdict(report).first()["issues_count"] == 1  # the missing time column


def test_row_gate_per_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in quality.row_gate(df, 2, keys=["k"]).collect()}
    assert got == {"a": (2, 2, True), "b": (1, 2, False)}
    assert quality.row_gate(df, 2, value="x").first()["rows"] == 2


def test_report_per_key(spark):
    """Two stations with the same stamps are no duplicates, and each has its own gaps."""
    start = datetime(2024, 1, 1)
    hours = {"a": list(range(30)), "b": [*range(0, 26), 60, 61]}
    rows = [(k, start + timedelta(hours=h), 1.0 + h) for k, hs in hours.items() for h in hs]
    df = spark.createDataFrame(rows, "k string, datetime timestamp_ntz, `PM2.5` double")
    got = found(quality.validate(df, required=["PM2.5"], keys=["k"]))
    assert got["duplicate_times", "datetime", "count"]["value"] == 0
    assert got["gaps", "datetime", "large_gaps"]["value"] == 1
    assert got["completeness", "datetime", "ratio"]["value"] == pytest.approx(58 / (30 + 62))
    assert found(quality.check_completeness(df, "datetime", keys=["k"])).popitem()[1]["severity"] == "warning"
    mixed = found(quality.validate(df, required=["PM2.5"]))
    assert mixed["duplicate_times", "datetime", "count"]["value"] == 26


def test_copies_of_rows_with_maps_and_signed_zeros(spark):
    rows = [({"a": 1, "b": 2}, 0.0), ({"b": 2, "a": 1}, -0.0), ({"a": 1}, 0.0), (None, 0.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "m map<string,int>, x double")
    assert copy_counts(df) == (5, 2)
    counted = {r["column"]: r for r in profiles.quality_counters(df).collect()}
    assert (counted["x"]["distinct_count"], counted["m"]["distinct_count"], counted["m"]["null_count"]) == (1, 2, 2)


def test_missing_stamps_are_no_repeats(spark):
    df = spark.createDataFrame([(None,), (None,), (None,)], "ts timestamp_ntz")
    assert quality.check_duplicate_times(df, "ts").first()["value"] == 0
