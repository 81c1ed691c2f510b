from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import dependence, profiles
from tidegauge.operators.order import Layout


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 24 * 400
    ts = pd.date_range("2023-06-01", periods=n, freq="h")
    x = 50 + 10 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, 3, n)
    y = 0.5 * x + rng.normal(0, 4, n)
    frame = pd.DataFrame({"ts": ts, "PM2.5": x.round(3), "y": y.round(3)})
    frame.loc[rng.random(n) < 0.1, "PM2.5"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark, pdf):
    rows = [
        (t.to_pydatetime(), None if np.isnan(a) else float(a), float(b))
        for t, a, b in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "ts timestamp_ntz, `PM2.5` double, y double").repartition(4).cache()


@pytest.mark.parametrize("bucket", ["hour", "month", "year"])
def test_profile_against_pandas(table, pdf, bucket):
    rows = {r[bucket]: r for r in profiles.profile(table, "PM2.5", bucket, "ts").collect()}
    want = pdf.groupby(getattr(pdf["ts"].dt, bucket))["PM2.5"].agg(["mean", "std", "min", "max", "count"])
    assert set(rows) == set(want.index)
    for b, w in want.iterrows():
        for n in ("mean", "std", "min", "max", "count"):
            assert rows[b][n] == pytest.approx(w[n])


def test_all_profiles_equal_the_single_ones(table):
    every = profiles.profiles(table, ["PM2.5", "y"], "ts")
    for v in ("PM2.5", "y"):
        for bucket in profiles.BUCKETS:
            single = {r[bucket]: r["mean"] for r in profiles.profile(table, v, bucket, "ts").collect()}
            part = every.where((F.col("variable") == v) & (F.col("bucket") == bucket)).collect()
            assert {r["bucket_value"]: pytest.approx(r["mean"]) for r in part} == single


def test_unknown_bucket(table):
    with pytest.raises(ValueError):
        profiles.profile(table, "y", "minute", "ts")


def test_extremes_first_bucket_wins_and_nulls_are_skipped(spark):
    rows = [(0, 5.0, 1.0, 9.0), (1, 7.0, 2.0, 8.0), (2, 7.0, 3.0, 7.0), (3, 5.0, 0.5, 6.0), (4, None, None, None)]
    df = spark.createDataFrame(rows, "hour int, mean double, min double, max double")
    row = profiles.extremes(df, "hour").first()
    assert (row["peak_hour"], row["peak_max"], row["low_hour"], row["low_min"]) == (1, 8.0, 0, 1.0)
    assert profiles.extremes(df.where("mean IS NULL"), "hour").count() == 0


def test_weekend_is_saturday_and_sunday(spark):
    df = spark.createDataFrame([(1, 10.0), (7, 20.0), (2, 5.0), (6, 7.0)], "dayofweek int, mean double")
    row = profiles.weekend_split(df).first()
    assert tuple(row) == (15.0, 6.0, 9.0, 150.0)


def test_seasons_without_data_are_ignored(spark):
    df = spark.createDataFrame([(3, 1.0), (4, 3.0), (12, 9.0)], "month int, mean double")
    seasons = profiles.season_averages(df)
    assert tuple(seasons.first()) == (2.0, None, None, 9.0)
    assert tuple(profiles.season_extremes(seasons).first()) == ("winter", "spring")


def test_trend_needs_two_years(spark):
    schema = "year int, mean double"
    row = profiles.yearly_trend(spark.createDataFrame([(2023, 1.0)], schema)).first()
    assert row["status"] == "insufficient" and row["slope"] is None
    row = profiles.yearly_trend(spark.createDataFrame([(2021, 10.0), (2022, 20.0), (2023, 25.0)], schema)).first()
    slope, intercept = np.polyfit([2021, 2022, 2023], [10, 20, 25], 1)
    assert row["slope"] == pytest.approx(slope) and row["intercept"] == pytest.approx(intercept)
    assert row["trend_direction"] == "increasing" and row["trend_strength"] == "strong"
    assert row["average_percent_change"] == pytest.approx((100 + 25) / 2)


@pytest.mark.parametrize(
    ("means", "label"),
    [([1, 2, 2], "increasing"), ([3, 2, 2], "decreasing"), ([1, 3, 2], "variable"), ([1], "increasing")],
)
def test_monotonic_trend(spark, means, label):
    df = spark.createDataFrame([(2020 + i, float(m)) for i, m in enumerate(means)], "year int, mean double")
    assert profiles.monotonic_trend(df).first()["trend"] == label


@pytest.mark.parametrize("layout", [Layout(), Layout("sliced", limit=100)], ids=["small", "large"])
def test_summary(table, pdf, layout):
    rows = {r["variable"]: r for r in profiles.summary(table, ["PM2.5", "y"], "ts", latest=True, layout=layout).collect()}
    for v in ("PM2.5", "y"):
        x = pdf[v].dropna()
        for n, want in (("mean", x.mean()), ("std", x.std()), ("median", x.median()), ("latest", x.iloc[-1])):
            assert rows[v][n] == pytest.approx(want)
        assert rows[v]["null_count"] == pdf[v].isna().sum()
        assert rows[v]["rows"] == len(pdf) and rows[v]["columns"] == 3


def test_quality_counters(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "b")]
    df = spark.createDataFrame(rows, "n int, s string")
    got = {r["column"]: r for r in profiles.quality_counters(df).collect()}
    assert (got["s"]["null_count"], got["s"]["distinct_count"], got["s"]["type"]) == (3, 2, "string")
    assert (got["n"]["distinct_count"], got["n"]["duplicate_rows"], got["n"]["total_nulls"]) == (3, 3, 3)
    approx = {r["column"]: r["distinct_count"] for r in profiles.quality_counters(df, approx=True).collect()}
    assert approx == {"n": 3, "s": 2}
    assert {r["duplicate_rows"] for r in profiles.quality_counters(df.distinct()).collect()} == {0}


def test_daily_means_show_empty_days(series):
    t = [datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 9), datetime(2024, 1, 4)]
    rows = profiles.daily_means(series([1.0, 3.0, 5.0], t), "x", "ts").orderBy("day").collect()
    assert [r["mean"] for r in rows] == [2.0, None, None, 5.0]


def test_pairwise_and_listwise_against_pandas(table, pdf):
    df = table.withColumn("one", F.lit(1.0))
    pairs = {(r["a"], r["b"]): r for r in dependence.pair_correlations(df, ["PM2.5", "y", "one"]).collect()}
    assert pairs["PM2.5", "y"]["r"] == pytest.approx(pdf["PM2.5"].corr(pdf["y"]))
    assert pairs["PM2.5", "one"]["r"] is None
    complete = pdf.dropna()
    listwise = dependence.pair_correlations(df, ["PM2.5", "y"], missing="listwise").first()
    assert listwise["r"] == pytest.approx(complete["PM2.5"].corr(complete["y"]))
    assert listwise["n"] == len(complete)
    with pytest.raises(ValueError):
        dependence.pair_correlations(df, ["y"])


def test_notable_pairs_are_sorted_and_labelled(spark):
    df = spark.createDataFrame(
        [("a", "b", 0.2), ("a", "c", -0.9), ("b", "c", 0.5)], "a string, b string, r double"
    )
    notable = dependence.notable_pairs(df)
    assert [(r["r"], r["strength"], r["direction"]) for r in notable.collect()] == [
        (-0.9, "strong", "negative"),
        (0.5, "moderate", "positive"),
    ]
    row = dependence.pair_summary(notable).first()
    assert tuple(row) == (2, 1, 1, 1, "a", "c", -0.9)
    empty = dependence.pair_summary(dependence.notable_pairs(df, 0.95)).first()
    assert empty["total_pairs"] == 0 and empty["strongest_r"] is None


def test_decomposition_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = 100
    x = 100 + np.arange(n) * 0.3 + np.tile([5, 1, -2, 0, 3, -4, -3], 15)[:n] + rng.normal(0, 1, n)
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(start + timedelta(days=i), float(v)) for i, v in enumerate(x)], "day timestamp_ntz, mean double"
    )
    trend = pd.Series(x).rolling(7, center=True).mean().to_numpy()
    detrended = x - trend
    phase = np.array([np.nanmean(detrended[i::7]) for i in range(7)])
    seasonal = np.resize(phase - phase.mean(), n)
    for layout in (Layout(), Layout("sliced", slice_rows=10)):
        rows = dependence.decompose(df, layout=layout).orderBy("day").collect()
        assert [r["seasonal"] for r in rows] == pytest.approx(list(seasonal))
        assert [r["trend"] for r in rows[3:-3]] == pytest.approx(list(trend[3:-3]))
        assert rows[0]["trend"] is None and rows[-1]["rest"] is None


def test_seasonal_strength_needs_enough_data(table):
    row = dependence.seasonal_strength(table, "PM2.5", "ts").first()
    assert row["days"] == 400 and 0 < row["seasonal_strength"] < 1
    assert dependence.seasonal_strength(table.limit(500), "PM2.5", "ts").count() == 0


def test_persistence_labels(spark):
    rows = [("a", 1, 0.9), ("a", 24, 0.6), ("b", 24, 0.3), ("c", 1, -0.95), ("d", 24, -0.8)]
    df = spark.createDataFrame(rows, "v string, lag int, r double")
    got = {r["v"]: tuple(r)[1:] for r in dependence.persistence(df, by=["v"]).collect()}
    assert got == {"a": (0.9, "high"), "b": (0.3, "moderate"), "c": (0.95, "low"), "d": (0.8, "low")}


def test_findings_text(table):
    rows = dependence.findings(table.withColumnRenamed("y", "PM10"), ["PM2.5", "PM10"], ["temperature"], "ts")
    got = {r["finding"]: r["text"] for r in rows.collect()}
    assert got["strongest_pair"].startswith("Strongest correlation: PM2.5 and PM10 (0.")
    assert got["persistence"] == "High persistence pollutants: PM2.5"
    assert "most_influential" not in got
