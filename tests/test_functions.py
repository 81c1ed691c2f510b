from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.columns import attach, c, hours_between, quoted
from tidegauge.functions import calendar, indices, rules, stats
from tidegauge.operators.features import add_air_quality, add_features, feature_list


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    ("x", "index"),
    [
        (0.0, 0.0),
        (12.0, 50.0),
        (12.05, 51 + 49 / 23.3 * (12.05 - 12.1)),
        (12.1, 51.0),
        (35.4, 100.0),
        (35.45, 101 + 49 / 19.9 * (35.45 - 35.5)),
        (55.4, 150.0),
        (56.0, 200.0),
        (None, None),
    ],
)
def test_sub_index_edges(spark, x, index):
    df = spark.createDataFrame([(x,)], "`PM2.5` double")
    value = one(df.select(indices.sub_index("PM2.5")))
    assert value is None if index is None else value == pytest.approx(index)


def test_levels_and_alerts(spark):
    df = spark.createDataFrame([(50.0,), (100.0,), (100.5,), (150.0,), (150.5,), (None,)], "i double")
    rows = df.select(indices.level(c("i")), indices.alert(c("i"))).collect()
    assert [r[0] for r in rows] == [
        "Good",
        "Moderate",
        "Unhealthy for Sensitive Groups",
        "Unhealthy for Sensitive Groups",
        "Unhealthy",
        None,
    ]
    assert [r[1] for r in rows] == ["ok", "ok", "warning", "warning", "alert", None]


def test_overall_index_skips_missing(spark):
    df = spark.createDataFrame([(10.0, None, 20.0), (None, None, None)], "`PM2.5` double, PM10 double, NO2 double")
    rows = add_air_quality(df).select("index", "level").collect()
    assert rows[0]["index"] == pytest.approx(10 * 50 / 12)
    assert rows[1]["index"] is None and rows[1]["level"] is None


def test_weighted_index_rounds_like_arrays_do(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    weights = {"a": 0.1, "b": 0.025}
    assert one(df.select(indices.weighted_index(weights, 2))) == 0.12  # 12.5 goes to even
    assert one(df.select(indices.weighted_index({"a": 2.0, "b": 1.0}))) == 3.0


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert one(df.select(indices.ratio("a", "b", 0.0))) is None
    assert one(df.select(indices.ratio("a", "b"))) == pytest.approx(1000)


def test_calendar_of_known_days(spark):
    rows = [(datetime(2024, 3, 2, 13),), (datetime(2024, 12, 29, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    ts = c("ts")
    p, iso = calendar.parts(ts), calendar.iso_parts(ts)
    out = df.select(
        p["hour"], p["dayofweek"], p["month"], iso["day_of_week"], iso["is_weekend"],
        calendar.day_name(ts), calendar.month_name(ts, True), calendar.season(p["month"]),
        calendar.day_name_of(p["dayofweek"]), calendar.month_name_of(p["month"]),
    ).collect()
    assert tuple(out[0]) == (13, 7, 3, 5, 1, "Saturday", "Mar", "spring", "Saturday", "March")
    assert tuple(out[1]) == (0, 1, 12, 6, 1, "Sunday", "Dec", "winter", "Sunday", "December")


def test_cyclical_with_given_pi(spark):
    df = spark.createDataFrame([(6, 1)], "h int, d int")
    exact = calendar.cyclical(c("h"), c("d"))
    rough = calendar.cyclical(c("h"), c("d"), pi=3.14159)
    row = df.select(exact["hour_sin"], rough["hour_sin"], exact["dayofweek_cos"]).first()
    assert row[0] == pytest.approx(1.0, abs=1e-15)
    assert row[1] == math.sin(6 * 2 * 3.14159 / 24)
    assert row[2] == pytest.approx(math.cos(2 * math.pi / 7))


def test_rules_let_nulls_pass(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 20.0), (2, None, None), (3, 0.0, 60.0), (4, 5.0, 61.0)],
        "id int, `PM2.5` double, temperature double",
    )
    good, bad = rules.split_by_rules(df)
    assert sorted(r["id"] for r in good.collect()) == [2, 3]
    assert {r["id"]: r["violations"] for r in bad.collect()} == {1: ["PM2.5"], 4: ["temperature"]}


def test_pearson_constant_and_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, k double")
    row = df.agg(stats.pearson(c("a"), c("b")), stats.pearson(c("a"), c("k"))).first()
    assert row[0] == pytest.approx(1.0) and row[1] is None


def test_adjusted_moments_against_pandas(spark):
    import pandas as pd

    x = [1.0, 2.0, 2.5, 7.0, 11.0, 3.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    row = df.agg(stats.adjusted_skew(c("x")), stats.adjusted_kurtosis(c("x"))).first()
    assert row[0] == pytest.approx(pd.Series(x).skew())
    assert row[1] == pytest.approx(pd.Series(x).kurtosis())
    two = df.limit(2).agg(stats.adjusted_skew(c("x")), stats.adjusted_kurtosis(c("x"))).first()
    assert tuple(two) == (None, None)


def test_strength_and_direction(spark):
    df = spark.createDataFrame([(0.8,), (-0.5,), (0.1,), (None,)], "r double")
    label = stats.strength(c("r"), [(0.7, "strong"), (0.4, "moderate")], "weak")
    rows = df.select(label, stats.direction(c("r"))).collect()
    assert [tuple(r) for r in rows] == [
        ("strong", "positive"),
        ("moderate", "negative"),
        ("weak", "positive"),
        (None, None),
    ]


def test_hours_between_needs_no_zone(spark):
    rows = [(datetime(2024, 3, 31, 4), datetime(2024, 3, 31, 1, 30))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert one(df.select(hours_between(c("a"), c("b")))) == 2.5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quoting_and_null_safe_attach(spark):
    assert quoted("a`b.c") == "`a``b.c`"
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "`k.1` string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "`k.1` string, y int")
    rows = attach(left, right, ["k.1"]).collect()
    assert {r["x"]: r["y"] for r in rows} == {1: 10, 2: 20, 3: None}
    total = right.agg(F.sum("y").alias("s"))
    assert {r["s"] for r in attach(left, total, []).collect()} == {30}


def test_feature_set_adapts_to_columns(spark, series):
    df = series([1.0, 2.0, 3.0]).withColumnRenamed("x", "PM2.5")
    out = add_features(df, "ts", lagged=["PM2.5"], steps=(1,), rolling=2)
    assert "AQI" not in out.columns and "PM_ratio" not in out.columns
    rows = out.orderBy("ts").select("`PM2.5_lag_1h`", "`PM2.5_rolling_2h`", "hour", "year").collect()
    assert [tuple(r) for r in rows] == [(None, 1.0, 0, 2024), (1.0, 1.5, 1, 2024), (2.0, 2.5, 2, 2024)]
    assert feature_list(out) == [
        "hour", "dayofweek", "month", "hour_sin", "hour_cos", "dayofweek_sin", "dayofweek_cos", "PM2.5_lag_1h",
    ]
    assert feature_list(out, ["month", "nothing"]) == ["month"]
