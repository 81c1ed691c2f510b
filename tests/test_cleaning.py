from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import clean, select, windows
from tidegauge.operators.order import Layout

GAPS = [1.0, None, None, 4.0, None]


def xs(df, column="x"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_the_four_fills(series):
    df = series(GAPS)
    assert xs(clean.fill_previous(df, ["x"], order=["ts"])) == [1, 1, None, 4, 4]
    assert xs(clean.fill_previous(df, ["x"], order=["ts"], limit=2)) == [1, 1, 1, 4, 4]
    assert xs(clean.ffill(df, ["x"], order=["ts"])) == [1, 1, 1, 4, 4]
    assert xs(clean.bfill(df, ["x"], order=["ts"])) == [1, 4, 4, 4, None]
    assert xs(clean.fill_mean(df, ["x"])) == [1, 2.5, 2.5, 4, 2.5]
    assert xs(clean.fill_mean(df, ["x"], {"x": 9.0})) == [1, 9, 9, 4, 9]


def test_all_null_stays_null(series):
    df = series([None, None])
    for fill in (clean.ffill, clean.bfill, clean.ffill_bfill):
        assert xs(fill(df, ["x"], order=["ts"])) == [None, None]
    assert xs(clean.fill_mean(df, ["x"])) == [None, None]
    assert clean.iqr_filter(df, ["x"]).count() == 2  # a column without values is skipped


def test_iqr_is_inclusive_and_drops_nulls(series):
    x = [1, 2, 3, 4, 5, 100, None]
    q1, q3 = np.quantile(x[:-1], [0.25, 0.75])
    high = q3 + 1.5 * (q3 - q1)
    df = series([*x, high])
    low, up = clean.iqr_bounds(df, ["x"])["x"]
    kept = xs(clean.iqr_filter(df, ["x"]))
    assert kept == [v for v in [*x, high] if v is not None and low <= v <= up]


def test_sequential_bounds_see_the_rows_left(spark):
    rows = [(i, float(i), float(i)) for i in range(20)] + [(20, 1000.0, 19.0), (21, 10.0, 40.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    seq = clean.iqr_filter(df, ["a", "b"])
    a = np.array([r[1] for r in rows])
    b = np.array([r[2] for r in rows])

    def inside(v, over):
        q1, q3 = np.quantile(over, [0.25, 0.75])
        return (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))

    first = inside(a, a)
    want = first & inside(b, b[first])
    assert sorted(r["id"] for r in seq.collect()) == [r[0] for r, k in zip(rows, want, strict=True) if k]
    joint = clean.iqr_filter(df, ["a", "b"], mode="joint")
    both = inside(a, a) & inside(b, b)
    assert sorted(r["id"] for r in joint.collect()) == [r[0] for r, k in zip(rows, both, strict=True) if k]
    with pytest.raises(ValueError):
        clean.iqr_filter(df, ["a"], mode="other")


def test_dedupe_keeps_the_first_by_tie(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(2, "a", t), (1, "a", t), (3, "b", t)], "id int, k string, ts timestamp_ntz")
    assert [r["id"] for r in clean.dedupe_ts(df, "ts", tie=["id"]).collect()] == [1]
    per_key = clean.dedupe_ts(df, "ts", keys=["k"], tie=["id"]).collect()
    assert sorted(r["id"] for r in per_key) == [1, 3]


def test_require_values_with_dotted_names(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, `PM2.5` double")
    assert [r["id"] for r in clean.require_values(df, ["PM2.5", "none"]).collect()] == [1]
    assert clean.require_values(df, ["none"]).count() == 2


def test_clean_parses_fills_filters_and_dedupes(spark):
    rows = [(f"2024-01-01 {h:02d}:00:00", float(10 + h % 3)) for h in range(20)]
    rows[4] = (rows[4][0], None)
    rows += [("not a time", 11.0), ("2024-01-01 20:00:00", 900.0), (rows[3][0], 12.0)]
    df = spark.createDataFrame(rows, "datetime string, `PM2.5` double")
    for layout in (Layout(), Layout("sliced", slice_rows=4, limit=5)):
        out = clean.clean(df, ["PM2.5", "absent"], fmt="yyyy-MM-dd HH:mm:ss", tie=["PM2.5"], layout=layout)
        got = {r["datetime"].hour: r["PM2.5"] for r in out.collect()}
        assert sorted(got) == list(range(20))
        # The gap takes the row before it, which is the second copy of three o'clock.
        assert got[4] == 12.0 and got[3] == 10.0
    with pytest.raises(ValueError):
        clean.clean(df, ["PM2.5"], fill="other")


def test_lag_backfill_and_names(series):
    df = series([5.0, 6.0, 7.0, 8.0])
    plain = windows.lags(df, ["x"], [2], order=["ts"])
    assert xs(plain, "x_lag_2") == [None, None, 5, 6]
    filled = windows.lags(df, ["x"], [2], order=["ts"], backfill=True)
    assert xs(filled, "x_lag_2") == [5, 5, 5, 6]


def test_gaps_changes_and_directions(series):
    t = [datetime(2024, 1, 1), datetime(2024, 1, 2, 6), datetime(2024, 1, 4, 6)]
    df = series([2.0, 1.0, 1.0], t)
    assert xs(windows.gap_hours(df, "ts"), "gap_hours") == [None, 30, 48]
    assert xs(windows.direction_of_change(df, ["x"], order=["ts"]), "x_direction") == [None, -1, 0]


def test_supervised_windows(series):
    rows = windows.supervised_windows(series(range(1, 9)), "x", 4, order=["ts"]).orderBy("ts").collect()
    assert len(rows) == 4
    assert rows[0]["window"] == [1, 2, 3, 4] and rows[0]["label"] == 5
    assert windows.supervised_windows(series([1, 2, 3]), "x", 4, order=["ts"]).count() == 0


def test_selection(spark, series):
    df = series(range(10))
    cut = select.between_ts(df, "ts", "2024-01-01 02:00:00", "2024-01-01 04:00:00")
    assert xs(cut) == [2, 3, 4]
    with pytest.raises(ValueError):
        select.between_ts(df, "ts", "2024-01-02", "2024-01-01")
    assert select.pick(df, ["x", "nope"], "ts").columns == ["ts", "x"]
    assert select.pick(df, ["nope"], "ts").columns == df.columns
    assert [r["id"] for r in select.last_n(df, 3, order=["ts"]).collect()] == [7, 8, 9]
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            select.last_n(df, n, order=["ts"])
    assert select.latest_row(df, order=["ts"]).first()["id"] == 9
    assert select.latest_row(df.limit(0), order=["ts"]).count() == 0
    assert select.head(df, 2, [F.col("x").desc()]).count() == 2


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,)], "v string")
    assert [r["v"] for r in select.to_numbers(df, ["v", "w"]).collect()] == [1.5, None, None, None]


def test_parse_drops_bad_times(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00",), ("01.01.2024",), (None,)], "datetime string")
    assert [r["datetime"] for r in select.parse_ts(df).collect()] == [datetime(2024, 1, 1, 5)]


def test_series_are_cleaned_apart(spark):
    """Two stations at different levels: own means, own bounds; over the table only when asked for."""
    rows = [("a", i, None if i < 2 else 10.0 + i % 3) for i in range(20)] + [("b", i, 1000.0 + i % 3) for i in range(20)]
    rows += [("a", 99, 500.0), (None, 0, 7.0)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + timedelta(hours=i), x) for k, i, x in rows], "k string, ts timestamp_ntz, x double")
    filled = {(r["k"], r["ts"]): r["x"] for r in clean.fill_mean(df.where("x is null or x < 400"), ["x"], keys=["k"]).collect()}
    assert 10 <= filled["a", start] <= 12
    got = clean.clean(df, ["x"], "ts", keys=["k"]).collect()
    assert all(r["x"] < 20 for r in got if r["k"] == "a") and sum(r["k"] == "b" for r in got) == 20
    assert [r["x"] for r in got if r["k"] is None] == [7.0]
    whole = clean.iqr_filter(df.where("x is not null"), ["x"])
    assert whole.where("x = 500").count() == 1
    own = clean.iqr_filter(df, ["x"], keys=["k"], layout=Layout("sliced", limit=5))
    assert own.where("x = 500").count() == 0 and own.where("k = 'b'").count() == 20


def test_keyed_cleaning_brings_the_rows_together_once(spark):
    """Fill, means, bounds of every column and one row per stamp: one exchange by key, the same rows as in slices."""
    from tidegauge.operators.order import Layout, settle

    rows = [(k, i // 2, i, None if i % 9 == 0 else float((i * 37) % 50 + (400 if i % 41 == 0 else 0)), float(i % 13)) for k in "abc" for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts bigint, id bigint, x double, y double").repartition(3)
    layout = settle(df, ["k"], Layout())
    out = clean.clean(df, ["x", "y"], "ts", keys=["k"], tie=["id"], layout=layout)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan
    cut = clean.clean(df, ["x", "y"], "ts", keys=["k"], tie=["id"], layout=Layout("sliced", slice_rows=50, limit=20))
    both = [sorted(tuple(r) for r in o.select(*df.columns).collect()) for o in (out, cut)]
    # The row after an outlier stands for their stamp.
    assert len(both[0]) == 180 and max(r[3] for r in both[0]) < 400
    assert [r[:3] for r in both[0]] == [r[:3] for r in both[1]]
    assert [r[3] for r in both[0]] == pytest.approx([r[3] for r in both[1]])
