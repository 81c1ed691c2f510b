"""Both layouts give the same rows as Pandas, whatever the skew, the partitions and the slices."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import autoreg, forecast, windows
from tidegauge.operators.order import (
    Layout,
    fill_gaps,
    number_rows,
    over_rows,
    settle,
    tail_rows,
)

ORDER = ["ts", "id"]
LAYOUTS = [
    Layout("grouped"),
    Layout("sliced", slice_rows=7),
    Layout("sliced", slice_rows=64),
    Layout("auto", limit=50, slice_rows=20),
]


def skewed(seed: int = 0, n: int = 400) -> pd.DataFrame:
    """Half of the rows on one key, a third on one stamp, a null key, a third of the values missing."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c", None], n))
    hours = np.where(rng.random(n) < 0.33, 5, rng.integers(0, 300, n))
    x = np.where(rng.random(n) < 0.33, np.nan, rng.normal(50, 20, n).round(3))
    start = datetime(2024, 1, 1)
    frame = pd.DataFrame({"id": np.arange(n), "k": keys, "x": x})
    frame["ts"] = [start + timedelta(hours=int(h)) for h in hours]
    return frame


@pytest.fixture(scope="module")
def table(spark):
    pdf = skewed()
    rows = [
        (int(r.id), r.k, r.ts.to_pydatetime(), None if np.isnan(r.x) else float(r.x)) for r in pdf.itertuples()
    ]
    return spark.createDataFrame(rows, "id bigint, k string, ts timestamp_ntz, x double").repartition(5)


def expected(by_key: bool, fn) -> dict[int, float | None]:
    pdf = skewed().sort_values(ORDER)
    parts = [g for _, g in pdf.groupby("k", dropna=False)] if by_key else [pdf]
    out = pd.concat([pd.Series(fn(g["x"]).to_numpy(dtype=float), index=g["id"]) for g in parts])
    return {int(i): None if np.isnan(v) else round(float(v), 6) for i, v in out.items()}


def got(df, column) -> dict[int, float | None]:
    rows = df.select("id", F.col(column).cast("double").alias("v")).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: None if r["v"] is None else round(r["v"], 6) for r in rows}


KEYS = [(), ("k",)]
both = pytest.mark.parametrize("layout", LAYOUTS, ids=lambda v: f"{v.how}-{v.slice_rows}")
keyed = pytest.mark.parametrize("keys", KEYS, ids=["one-series", "per-key"])


@both
@keyed
def test_lag_longer_than_a_slice(table, layout, keys):
    out = over_rows(
        table, lambda w: {"v": F.lag("x", 11).over(w)}, keys=keys, order=ORDER, before=11, layout=layout
    )
    assert got(out, "v") == expected(bool(keys), lambda s: s.shift(11))


@both
@keyed
def test_rolling_mean_partial_and_full(table, layout, keys):
    out = windows.rolling_mean(table, ["x"], 9, keys=keys, order=ORDER, layout=layout, name=lambda v, n: "p")
    assert got(out, "p") == expected(bool(keys), lambda s: s.rolling(9, min_periods=1).mean())
    out = windows.rolling_mean(
        table, ["x"], 9, keys=keys, order=ORDER, min_periods=9, layout=layout, name=lambda v, n: "f"
    )
    assert got(out, "f") == expected(bool(keys), lambda s: s.rolling(9).mean())


@both
@keyed
def test_centred_mean_reads_both_sides(table, layout, keys):
    out = windows.rolling_mean(
        table, ["x"], 7, keys=keys, order=ORDER, min_periods=7, centred=True, layout=layout,
        name=lambda v, n: "m",
    )
    assert got(out, "m") == expected(bool(keys), lambda s: s.rolling(7, center=True).mean())


@both
@keyed
@pytest.mark.parametrize("how", ["forward", "back", "both"])
def test_fill(table, layout, keys, how):
    fills = {
        "forward": lambda s: s.ffill(),
        "back": lambda s: s.bfill(),
        "both": lambda s: s.ffill().bfill(),
    }
    out = fill_gaps(table, ["x"], keys=keys, order=ORDER, how=how, layout=layout)
    assert got(out, "x") == expected(bool(keys), fills[how])
    assert sorted(out.columns) == sorted(table.columns)


@both
@keyed
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers(table, layout, keys, descending):
    out = number_rows(table, keys=keys, order=ORDER, descending=descending, layout=layout)
    want = expected(
        bool(keys),
        lambda s: pd.Series(range(len(s), 0, -1) if descending else range(1, len(s) + 1)),
    )
    assert got(out, "rn") == want


@both
@keyed
@pytest.mark.parametrize("alpha", [0.3, 0.9, 1.0])
def test_smoothing(table, layout, keys, alpha):
    def loop(s):
        level, out = None, []
        for v in s:
            if not np.isnan(v):
                level = v if level is None else alpha * v + (1 - alpha) * level
                out.append(level)
            else:
                out.append(np.nan)
        return pd.Series(out)

    out = windows.smooth(table, "x", alpha, keys=keys, order=ORDER, layout=layout)
    want = {i: v for i, v in expected(bool(keys), loop).items() if v is not None}
    assert got(out, "smoothed") == want


@both
@keyed
def test_tails(table, layout, keys):
    out = tail_rows(table, 13, keys=keys, order=ORDER, layout=layout)
    pdf = skewed().sort_values(ORDER)
    want = pdf.groupby("k", dropna=False).tail(13) if keys else pdf.tail(13)
    assert sorted(r["id"] for r in out.collect()) == sorted(want["id"])


@both
def test_rolling_corr_against_pandas(table, layout):
    rows = table.where(F.col("x").isNotNull())
    out = windows.rolling_corr(rows, "x", 12, keys=["k"], order=ORDER, layout=layout)
    have = got(out, "x_corr_12")

    def corr(s):
        s = s.dropna()
        return s.rolling(12).corr(s.shift(12))

    pdf = skewed().dropna(subset=["x"]).sort_values(ORDER)
    want = {}
    for _, g in pdf.groupby("k", dropna=False):
        r = g["x"].rolling(12).corr(g["x"].shift(12))
        want |= {int(i): None if np.isnan(v) else round(float(v), 6) for i, v in zip(g["id"], r, strict=True)}
    assert have == want


@pytest.mark.parametrize("layout", LAYOUTS[:2], ids=["grouped", "sliced"])
@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, layout, n):
    rows = [(1, datetime(2024, 1, 1), 2.0)][:n]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, x double")
    assert number_rows(df, order=ORDER, layout=layout).count() == n
    assert fill_gaps(df, ["x"], order=ORDER, how="both", layout=layout).count() == n
    assert windows.lags(df, ["x"], [1], order=ORDER, layout=layout).count() == n
    assert windows.smooth(df, "x", order=ORDER, layout=layout).count() == n


def test_auto_layout_checks_the_largest_key(table):
    hot = table.where(F.col("k") == "hot").count()
    assert settle(table, ["k"], Layout(limit=hot)).how == "grouped"
    assert settle(table, ["k"], Layout(limit=hot - 1)).how == "sliced"


def test_partitioning_does_not_matter(table):
    layout = Layout("sliced", slice_rows=16)
    runs = []
    for parts in (1, 8):
        out = windows.lags(table.repartition(parts), ["x"], [1, 24], keys=["k"], order=ORDER, layout=layout)
        runs.append(sorted(map(tuple, out.select("id", "x_lag_1", "x_lag_24").fillna(-1).collect())))
    assert runs[0] == runs[1]


def test_unknown_layout():
    with pytest.raises(ValueError):
        Layout("other")


def test_copies_of_one_row_spread_over_partitions(spark):
    """A third of all rows with one key and one stamp, all equal, still ends in many partitions."""
    from tidegauge.operators.order import _numbered

    rows = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k",
        "CASE WHEN id % 3 = 0 THEN 1.0D ELSE id * 1.0D END AS x",
    )
    rows = rows.repartition(16)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(merge, "false")
        placed = _numbered(rows, ["k"], ["x"], 500, None)
    finally:
        spark.conf.set(merge, "true")
    assert placed.select(F.max("__pos"), F.count("*")).first()[:] == (5999, 6000)
    from_file = placed.where("k = 0").select(F.input_file_name().alias("f")).distinct().count()
    assert from_file > 1
    assert placed.groupBy("__slice").count().agg(F.max("count")).first()[0] == 500


def test_tied_rows_have_one_order_in_every_layout(spark):
    rows = [(i % 2, i // 50, i, float((i * 7919) % 1009)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, ts int, id int, x double").repartition(7)
    layouts = [Layout("grouped"), Layout("sliced", slice_rows=90), Layout(limit=100, slice_rows=90), Layout()]
    for keys in (["k"], []):
        seen = set()
        for how in [*layouts, settle(df, keys, Layout(limit=100, slice_rows=90))]:
            lagged = over_rows(df, lambda w: {"y": F.lag("x", 3).over(w)}, keys=keys, order=["ts"], before=3, layout=how)
            first = lagged.agg(F.sum(F.col("id") * F.col("y"))).first()[0]
            numbered = number_rows(df, keys=keys, order=["ts"], layout=how).agg(F.sum(F.col("rn") * F.col("id"))).first()[0]
            back = number_rows(df, keys=keys, order=["ts"], descending=True, layout=how).agg(F.sum(F.col("rn") * F.col("id"))).first()[0]
            tail = tail_rows(df, 7, keys=keys, order=["ts"], layout=how).agg(F.sum("id")).first()[0]
            gaps = df.withColumn("x", F.when(F.col("id") % 3 == 0, F.col("x")))
            filled = [
                fill_gaps(gaps, ["x"], keys=keys, order=["ts"], how=h, layout=how).agg(F.sum(F.col("id") * F.col("x"))).first()[0]
                for h in ("forward", "back", "both")
            ]
            seen.add((first, numbered, back, tail, *filled))
        assert len(seen) == 1


def test_sizes_stay_with_a_settled_layout(spark):
    df = spark.range(3000).select((F.col("id") % 500).alias("k"), "id")
    settled = settle(df, ["k"], Layout(slice_rows=300))
    assert (settled.how, settled.largest, settled.total) == ("grouped", 6, 3000)


def recurrence(values, alpha):
    level, out = None, []
    for x in values:
        level = x if level is None else alpha * x + (1 - alpha) * level
        out.append(level)
    return out


@pytest.mark.parametrize("how", ["grouped", "sliced"])
@pytest.mark.parametrize(("alpha", "rows"), [(1e-6, 100), (0.001, 7), (0.3, 400), (1 - 1e-12, 400)])
def test_smoothing_keeps_the_whole_history(spark, how, alpha, rows):
    """Far more rows than a block holds, slices of a few rows, and a first value that outweighs the rest."""
    r = np.random.default_rng(4)
    n = 3000
    x = np.where(np.arange(n) == 0, 1e9, r.normal(size=n))
    x[1500:1900] = 0.0
    df = spark.createDataFrame([(i % 2, i, float(v)) for i, v in enumerate(np.repeat(x, 2))], "k int, id long, x double")
    for keys, pick in (([], np.repeat(x, 2)), (["k"], x)):
        out = windows.smooth(df, "x", alpha, keys=keys, order=["id"], layout=Layout(how, slice_rows=rows))
        got = out.where("k = 0").orderBy("id").select("smoothed").toPandas()["smoothed"].to_numpy()
        want = np.array(recurrence(pick, alpha))[:: 1 if keys else 2]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-300)


def test_smoothing_of_tied_times_is_one_answer(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 37).alias("ts"), (F.xxhash64("id") % 1000).cast("double").alias("x"), F.lit(1).alias("k")
    )
    for keys in ([], ["k"]):
        seen = set()
        for frame, layout in ((rows, Layout("grouped")), (rows.orderBy("x"), Layout("sliced", slice_rows=400))):
            out = windows.smooth(frame, "x", 0.3, keys=keys, order=["ts"], layout=layout)
            ends = forecast.forecast_paths(frame, "x", forecast.exponential_smoothing(), 1, keys=keys, order=["ts"], layout=layout)
            last = autoreg.fit_autoregression(frame, "x", keys=keys, order=["ts"], layout=layout)
            row = out.agg(F.sum(F.col("x") * F.col("smoothed"))).first()[0]
            seen.add((round(row, 3), round(ends.first()["forecast"], 9), round(last.first()["rss"], 4)))
        assert len(seen) == 1


def test_maps_may_stand_beside_ordered_columns(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2}), (2, None)], "ts int, m map<string,int>")
    assert number_rows(df, order=["ts"], layout=Layout("sliced", slice_rows=2)).count() == 3
