from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import autoreg, catalog, evaluate, forecast, mlprep
from tidegauge.operators.order import Layout

START = datetime(2024, 1, 1)
LAYOUTS = [Layout(), Layout("sliced", slice_rows=40, limit=40)]
both = pytest.mark.parametrize("layout", LAYOUTS, ids=["plain", "sliced"])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    t = np.arange(200)
    return {
        "wave": (50 + 20 * np.sin(0.1 * t) + rng.normal(0, 5, 200)).round(4),
        "walk": np.cumsum(rng.normal(0, 1, 200)).round(4),
        "short": np.array([1.0, 2.0, 3.0, 4.0, 5.0]),
    }


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(k, START + timedelta(hours=i), float(v)) for k, x in data.items() for i, v in enumerate(x)]
    rows += [("wave", START + timedelta(hours=300), None)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, x double").repartition(5).cache()


HOW = {"keys": ["k"], "order": ["ts"]}


def paths(df, column="forecast"):
    out = {}
    for r in df.orderBy("step").collect():
        out.setdefault(r["k"], []).append(r[column])
    return out


@both
def test_moving_average(table, data, layout):
    df = forecast.moving_average_forecast(table, "x", layout=layout, **HOW)
    got, low = paths(df), paths(df, "confidence_lower")
    assert set(got) == {"wave", "walk"}  # five points are too few
    for k in got:
        x = data[k]
        assert got[k] == pytest.approx([x[-24:].mean()] * 24)
        assert low[k][0] == pytest.approx(x[-24:].mean() - 1.96 * x[-48:].std(ddof=1))


@both
@pytest.mark.parametrize("weights", [None, [1, 0, 0, 2]])
def test_weighted_average_feeds_itself(table, data, layout, weights):
    method = forecast.weighted_moving_average(4, weights)
    got = paths(forecast.forecast_paths(table, "x", method, 10, layout=layout, **HOW))
    w = np.array(weights or [1, 2, 3, 4], dtype=float)
    for k, x in data.items():
        x = list(x)
        for _ in range(10):
            x.append(np.average(x[-4:], weights=w))
        assert got[k] == pytest.approx(x[-10:])


def test_seasonal_naive_repeats(table, data):
    got = paths(forecast.forecast_paths(table, "x", forecast.seasonal_naive(5), 12, **HOW))
    assert got["short"] == [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 1, 2]
    assert got["walk"] == pytest.approx(list(np.resize(data["walk"][-5:], 12)))


@both
@pytest.mark.parametrize("alpha", [0.3, 0.05, 1.0])
def test_exponential_smoothing(table, data, layout, alpha):
    got = paths(forecast.forecast_paths(table, "x", forecast.exponential_smoothing(alpha), 2, layout=layout, **HOW))
    assert "short" not in got
    for k in got:
        level = data[k][0]
        for v in data[k][1:]:
            level = alpha * v + (1 - alpha) * level
        assert got[k] == pytest.approx([level] * 2)


def test_ensemble_and_protocol(table):
    out = forecast.ensemble_forecast(table, "x", 6, **HOW)
    row = out.where("k = 'walk' AND step = 3").first()
    four = [row[m.name] for m in forecast.simple_methods()]
    assert row["forecast"] == pytest.approx(np.mean(four))
    assert row["confidence_upper"] == pytest.approx(np.mean(four) + 1.96 * np.std(four))
    for name in [*forecast.AVAILABLE, "autoregressive"]:
        assert forecast.forecast(table, "x", name, 6, **HOW).columns == ["k", "step", "forecast"]
    with pytest.raises(ValueError):
        forecast.forecast(table, "x", "magic", **HOW)
    for steps in (0, 169):
        with pytest.raises(ValueError):
            forecast.forecast(table, "x", "ensemble", steps, **HOW)
    with pytest.raises(ValueError):
        forecast.weighted_average_path(F.lit(None), 3, 4, [1, 2])


def test_timeline_starts_an_hour_after_the_last_row(table):
    rows = forecast.timeline(table, "x", "moving_average", 2, **HOW).where("k = 'walk'").orderBy("step").collect()
    assert [r["ts"] for r in rows] == [START + timedelta(hours=200), START + timedelta(hours=201)]
    assert {(r["target"], r["method"]) for r in rows} == {("x", "moving_average")}
    one = forecast.timeline(table.where("k = 'walk'").drop("k"), "x", "moving_average", 1, order=["ts"]).first()
    assert one["ts"] == START + timedelta(hours=200)


def least_squares(x: np.ndarray):
    """All orders fitted by least squares on the rows with three predecessors."""
    best = None
    for d in (0, 1):
        for p in (0, 1, 2):
            z = np.diff(x) if d else x
            y = z[-(len(x) - 3) :]
            cols = [np.ones(len(y))] + [z[len(z) - len(y) - j : len(z) - j] for j in range(1, p + 1)]
            a = np.column_stack(cols)
            beta, *_ = np.linalg.lstsq(a, y, rcond=None)
            rss = float(((y - a @ beta) ** 2).sum())
            score = (len(y) * np.log(rss / len(y)) + 2 * (p + 1), p, d, beta, rss, len(y))
            if best is None or score[:3] < best[:3]:
                best = score
    return best


@both
def test_autoregression_against_least_squares(table, data, layout):
    fits = {r["k"]: r for r in autoreg.fit_autoregression(table, "x", layout=layout, **HOW).collect()}
    assert set(fits) == {"wave", "walk"}
    for k in ("walk",):
        aic, p, d, beta, rss, n = least_squares(data[k])
        got = fits[k]
        assert (got["p"], got["d"], got["n"]) == (p, d, n)
        assert got["aic"] == pytest.approx(aic) and got["rss"] == pytest.approx(rss)
        assert [got["const"], got["b1"], got["b2"]][: p + 1] == pytest.approx(list(beta), abs=1e-9)


def test_autoregressive_path_and_interval(table, data):
    x = np.append(data["wave"], data["wave"][-1])  # the last gap is filled forward
    _, p, d, beta, rss, n = least_squares(x)
    beta = [*beta, 0.0, 0.0][:3]
    z = list(np.diff(x)) if d else list(x)
    level, want, psi, width = x[-1], [], [1.0], []
    for h in range(5):
        z.append(beta[0] + beta[1] * z[-1] + beta[2] * z[-2])
        level = level + z[-1] if d else z[-1]
        want.append(level)
        weights = np.cumsum(psi) if d else np.array(psi)
        width.append(1.959963984540054 * np.sqrt((weights**2).sum() * rss / n))
        psi.append(beta[1] * psi[-1] + beta[2] * (psi[-2] if len(psi) > 1 else 0.0))
    out = autoreg.autoregressive_forecast(table, "x", 5, **HOW)
    assert paths(out)["wave"] == pytest.approx(want)
    upper = paths(out, "confidence_upper")["wave"]
    assert np.array(upper) - np.array(want) == pytest.approx(np.array(width))


def test_constant_series_forecasts_its_constant(spark):
    rows = [(START + timedelta(hours=i), 5.0) for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    out = autoreg.autoregressive_forecast(df, "x", 3, order=["ts"]).collect()
    assert [r["forecast"] for r in out] == [5.0] * 3
    assert [r["confidence_upper"] for r in out] == [5.0] * 3


def scored(spark, actual, predicted):
    rows = [(i, float(a), float(p)) for i, (a, p) in enumerate(zip(actual, predicted, strict=True))]
    return spark.createDataFrame(rows, "i int, actual double, predicted double")


def test_metrics_of_the_known_pair(spark):
    df = scored(spark, [20, 25, 30, 35, 40], [25, 30, 35, 40, 45])
    row = evaluate.metrics(df, order=["i"]).first()
    assert (row["mae"], row["rmse"], row["directional_accuracy"], row["n_samples"]) == (5, 5, 100, 5)
    assert row["r2"] == pytest.approx(1 - 125 / 250) and row["normalized_mae"] == pytest.approx(0.25)
    assert row["median_absolute_error"] == 5 and row["residual_mean"] == -5


@both
def test_metrics_against_numpy(spark, layout):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 5, 300).astype(float)
    p = y + rng.normal(0, 1, 300)
    row = evaluate.metrics(scored(spark, y, p).repartition(4), order=["i"], layout=layout).first()
    e = y - p
    some = y != 0
    assert row["mape"] == pytest.approx(np.mean(np.abs(e[some] / y[some])) * 100)
    assert row["median_absolute_error"] == pytest.approx(np.median(np.abs(e)))
    assert row["directional_accuracy"] == pytest.approx(np.mean(np.sign(np.diff(y)) == np.sign(np.diff(p))) * 100)
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["residual_std"] == pytest.approx(e.std())


def test_metric_edges(spark):
    same = evaluate.metrics(scored(spark, [0, 0], [0, 0]), order=["i"]).first()
    assert (same["r2"], same["mape"], same["normalized_rmse"]) == (1.0, None, None)
    off = evaluate.metrics(scored(spark, [3, 3], [3, 4]), order=["i"]).first()
    assert off["r2"] == 0.0
    single = evaluate.metrics(scored(spark, [3], [4]), order=["i"]).first()
    assert single["directional_accuracy"] is None and single["r2"] is None
    assert evaluate.metrics(scored(spark, [], []), order=["i"]).count() == 0


def test_pairing_checks_lengths(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, actual double")
    b = spark.createDataFrame([(1, 1.0)], "i int, predicted double")
    with pytest.raises(ValueError, match="length mismatch"):
        evaluate.paired(a, b, ["i"])
    assert evaluate.paired(a, b, ["i"], strict=False).count() == 1


@both
def test_residuals_against_pandas(spark, layout):
    import pandas as pd

    rng = np.random.default_rng(4)
    e = pd.Series(rng.gamma(2, 2, 150))
    df = scored(spark, e, np.zeros(150))
    row = evaluate.residual_analysis(df, order=["i"], layout=layout).first()
    assert row["skewness"] == pytest.approx(e.skew()) and row["kurtosis"] == pytest.approx(e.kurtosis())
    assert row["q25"] == pytest.approx(e.quantile(0.25)) and row["median"] == pytest.approx(e.median())
    assert row["autocorrelation_lag1"] == pytest.approx(np.corrcoef(e[:-1], e[1:])[0, 1])
    assert not row["is_centered"] and not row["has_autocorrelation"]


@both
def test_backtests_agree_and_respect_the_minimum(table, data, layout):
    how = {"n_splits": 3, "test_size": 10, "layout": layout, **HOW}
    direct = evaluate.backtest_forecasts(table, "x", forecast.moving_average(6), **how)

    def plug_in(df, value, steps, **kw):
        return forecast.forecast(df, value, "moving_average", steps, window=6, **kw)

    general = evaluate.backtest_with(table, "x", plug_in, **how)

    def rows(df):
        return sorted(
            (r["k"], r["fold"], r["step"], round(r["actual"], 9), round(r["predicted"], 9)) for r in df.collect()
        )

    want = []
    for k in ("wave", "walk"):
        x = data[k]
        for fold in range(3):
            end = 200 - (3 - fold) * 10
            mean = x[end - 6 : end].mean()
            want += [(k, fold + 1, s + 1, round(x[end + s], 9), round(mean, 9)) for s in range(10)]
    assert rows(direct) == rows(general) == sorted(want)
    assert evaluate.backtest_forecasts(table, "x", forecast.moving_average(6), n_splits=11, test_size=10, **HOW).count() == 0
    scores = evaluate.fold_scores(direct, keys=["k"])
    summary = evaluate.backtest_summary(scores, keys=["k"]).where("k = 'walk'").first()
    maes = [r["mae"] for r in scores.where("k = 'walk'").collect()]
    assert summary["mae_mean"] == pytest.approx(np.mean(maes)) and summary["mae_std"] == pytest.approx(np.std(maes))


def test_one_series_backtest(table, data):
    df = table.where("k = 'walk'").drop("k")

    def plug_in(frame, value, steps, **kw):
        return forecast.forecast(frame, value, "seasonal_naive", steps, period=10, **kw)

    out = evaluate.backtest_with(df, "x", plug_in, n_splits=2, test_size=10, order=["ts"])
    first = out.where("fold = 1").orderBy("step").collect()
    assert [r["predicted"] for r in first] == pytest.approx(list(data["walk"][170:180]))
    assert [r["actual"] for r in first] == pytest.approx(list(data["walk"][180:190]))


@pytest.fixture(scope="module")
def scores(spark):
    rows = [("a", "x", 1.0, 0.5, 60.0), ("b", "x", 2.0, 0.9, None), ("c", "x", None, 0.1, 70.0), ("d", "y", 3.0, 0.3, 10.0)]
    return spark.createDataFrame(rows, "model_name string, target string, rmse double, r2 double, directional_accuracy double")


def test_ranking_and_best(scores):
    def order(metric):
        ranked = evaluate.rank_models(scores, metric, by=["target"]).where("target = 'x'")
        return [r["model_name"] for r in ranked.orderBy("rank").collect()]

    assert order("rmse") == ["a", "b", "c"]
    assert order("r2") == ["b", "a", "c"]
    assert order("directional_accuracy") == ["c", "a", "b"]
    assert evaluate.best_model(scores, "rmse").first()["model_name"] == "a"
    assert evaluate.best_model(scores, "r2", target="y").first()["model_name"] == "d"
    assert evaluate.best_model(scores, target="none").count() == 0
    best = evaluate.best_model(scores, "directional_accuracy", per_target=True).collect()
    assert {r["target"]: r["model_name"] for r in best} == {"x": "c", "y": "d"}


def test_ranking_without_groups_keeps_ties_and_puts_missing_scores_last(spark):
    values = [3.0, 1.0, None, 1.0, 2.0, None, 3.0, 0.5]
    rows = [(i, v, v) for i, v in enumerate(values)]
    scores = spark.createDataFrame(rows, "id int, rmse double, r2 double")
    for metric, sign in (("rmse", 1), ("r2", -1)):
        got = {r["id"]: r["rank"] for r in evaluate.rank_models(scores, metric).collect()}
        known = [sign * v for v in values if v is not None]
        assert got == {i: 1 + sum(x < sign * v for x in known) if v is not None else 1 + len(known) for i, v in enumerate(values)}


def test_catalogue(spark):
    rows = [
        ("m1", "wind model", "ARIMA", "1.0.9", "NO2", ["daily"], datetime(2024, 1, 1)),
        ("m2", "wind model", "ARIMA", "1.0.10", "NO2", ["best"], datetime(2024, 1, 2)),
        ("m3", "other", "LSTM", "beta", "PM2.5", [], datetime(2024, 1, 3)),
    ]
    runs = spark.createDataFrame(
        rows,
        "model_id string, model_name string, model_type string, version string, target string, "
        "tags array<string>, created_at timestamp_ntz",
    )
    assert [r["model_id"] for r in catalog.find_runs(runs, model_type="ARIMA").collect()] == ["m2", "m1"]
    assert [r["model_id"] for r in catalog.find_runs(runs, tags=["daily", "x"]).collect()] == ["m1"]
    assert catalog.find_runs(runs, tags=[]).count() == 0
    assert catalog.find_runs(runs, target="PM2.5").count() == 1
    assert catalog.latest_versions(runs, "wind model").first()["version"] == "1.0.10"
    following = {r["model_name"]: r["next_version"] for r in catalog.next_version(runs).collect()}
    assert following == {"wind model": "1.0.11", "other": "beta.1"}
    names = runs.select(catalog.run_id(F.col("model_type"), F.col("model_name"), F.col("created_at")))
    assert names.first()[0] == "ARIMA_wind_model_20240101_000000"


def test_scaling_matches_spark_ml(spark):
    from pyspark.ml.functions import vector_to_array

    rows = [(float(i), float(i * i), 3.0, None if i == 4 else 1.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, k double, n double")
    names = ["a", "b", "k", "n"]
    mine = mlprep.scale(df, names).orderBy("a").collect()
    ml = mlprep.ml_stages(names).fit(df).transform(df)
    theirs = ml.select("a", vector_to_array("scaled_features").alias("v")).orderBy("a").collect()
    assert [r["a"] for r in mine] == [r["a"] for r in theirs]
    for m, t in zip(mine, theirs, strict=True):
        assert m["scaled_features"] == pytest.approx(t["v"])
    assert mlprep.scale(df, names, as_vector=True).schema["scaled_features"].dataType.typeName() == "vectorudt"


def test_autoregression_of_a_wandering_series_far_from_zero(spark):
    """Lagged levels are almost equal here; the fit must still match least squares."""
    rng = np.random.default_rng(6)
    x = 1e6 + np.cumsum(rng.normal(0.5, 1, 400))
    rows = [(START + timedelta(hours=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    got = autoreg.fit_autoregression(df, "x", order=["ts"]).first()
    # Least squares on centred values, for the same reason.
    _, p, d, beta, rss, n = least_squares(x - 1e6)
    assert (got["p"], got["d"], got["n"]) == (p, d, n)
    assert got["rss"] == pytest.approx(rss, rel=1e-6)


def test_overall_rank_of_scores_that_differ_when_taken_again(spark):
    from random import SystemRandom

    from pyspark.sql import functions as F

    # Forked workers share the state of the plain generator.
    noisy = F.udf(lambda i: i + SystemRandom().random() / 1e6, "double").asNondeterministic()
    scores = spark.range(40).select("id", noisy("id").alias("mae"))
    got = {r["id"]: r["rank"] for r in evaluate.rank_models(scores, "mae").collect()}
    assert got == {i: i + 1 for i in range(40)}


@pytest.mark.parametrize("layout", LAYOUTS, ids=["grouped", "sliced"])
def test_autoregressive_backtest_copies_no_rows(spark, table, layout, monkeypatch):
    """The same rows as with a copy per fold; the number of rows that are laid out does not grow with the folds."""
    from tidegauge.operators import autoreg, order

    placed = []
    numbered = order._numbered
    monkeypatch.setattr(order, "_numbered", lambda df, *a, **k: (placed.append(df.count()), numbered(df, *a, **k))[1])
    for folds in (3, 6):
        how = {"n_splits": folds, "test_size": 10, "layout": layout, **HOW}
        general = evaluate.backtest_with(table, "x", autoreg.autoregressive_forecast, **how)
        placed.clear()
        direct = autoreg.backtest_autoregression(table, "x", **how)
        assert placed == ([] if layout.how == "auto" else [table.where("x IS NOT NULL").count()])
        key = lambda r: (str(r["k"]), r["fold"], r["step"])
        a, b = sorted(general.collect(), key=key), sorted(direct.collect(), key=key)
        assert a and [key(r) for r in a] == [key(r) for r in b]
        assert [r["actual"] for r in a] == [r["actual"] for r in b]
        assert [r["predicted"] for r in a] == pytest.approx([r["predicted"] for r in b], rel=1e-9)
    assert autoreg.backtest_autoregression(table, "x", n_splits=11, test_size=10, layout=layout, **HOW).count() == 0
