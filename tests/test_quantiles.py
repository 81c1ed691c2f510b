from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.order import Layout
from tidegauge.operators.quantiles import between, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def values(kind: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(0, 10, 4000),
        "constant": np.full(3000, 4.5),
        "hot value": np.where(rng.random(4000) < 0.6, 7.0, rng.normal(7, 1, 4000)),
        "two values": np.where(rng.random(4000) < 0.3, 1.0, 2.0),
        "stretched": np.exp(rng.normal(0, 8, 4000)),
        "integers": rng.integers(0, 50, 4000).astype(float),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "constant", "hot value", "two values", "stretched", "integers"])
def test_bracketed_quantiles_are_exact(spark, kind):
    x = values(kind)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = quantiles(df, ["x"], PROBS, layout=Layout("sliced", limit=100))
    have = {r["prob"]: r["quantile"] for r in out.collect()}
    for p in PROBS:
        assert have[p] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_groups_large_and_small_with_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(v)) for v in rng.normal(0, 1, 3000)]
    rows += [("small", float(v)) for v in rng.normal(0, 1, 20)]
    rows += [(None, float(v)) for v in rng.normal(5, 1, 2500)] + [("none", None)] * 5
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    out = quantiles(df, ["x"], [0.25, 0.5], by=["k"], layout=Layout("sliced", limit=100)).collect()
    have = {(r["k"], r["prob"]): r["quantile"] for r in out if r["quantile"] is not None}
    for k in ("big", "small", None):
        x = [v for g, v in rows if g == k]
        for p in (0.25, 0.5):
            assert have[(k, p)] == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert not any(k == "none" for k, _ in have)


def test_plain_and_bracketed_agree(spark):
    df = spark.range(2000).selectExpr("pmod(id * 7919, 2003) / 7.0 AS x", "cast(null as double) AS y")
    plain = quantiles(df, ["x", "y"], PROBS, layout=Layout("grouped"))
    split = quantiles(df, ["x", "y"], PROBS, layout=Layout("sliced", limit=50))
    key = lambda r: (r["variable"], r["prob"])
    a = {key(r): r["quantile"] for r in plain.collect()}
    b = {key(r): r["quantile"] for r in split.collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) if a[k] is not None else b[k] is None for k in a)


def test_approximate_mode_stays_close(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) AS x")
    value = quantiles(df, ["x"], [0.5], approx=True).first()["quantile"]
    assert abs(value - 5000) < 50


def test_key_names_that_look_internal(spark):
    rows = [(i % 2, i % 3, float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "n int, rank int, x double")
    plain = quantiles(df, ["x"], [0.5], by=["n", "rank"], layout=Layout("grouped"))
    split = quantiles(df, ["x"], [0.5], by=["n", "rank"], layout=Layout("sliced", limit=10))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    auto = quantiles(df, ["x"], [0.5], by=["n"])
    assert auto.count() == 2


def test_interpolation_is_rounded_as_in_sql(spark):
    """Quartiles of two-digit values equal the SQL's to the last bit, in small and in large groups."""
    import duckdb

    rng = np.random.default_rng(11)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 400, 20_000), rng.integers(1, 30_000, 20_000) / 100, strict=True)]
    df = spark.createDataFrame(rows, "k bigint, x double")
    con = duckdb.connect()
    con.register("t", df.toPandas())
    sql = "SELECT k, quantile_cont(x, 0.25), quantile_cont(x, 0.75), quantile_cont(x, 0.9) FROM t GROUP BY 1"
    want = {(k, p): q for k, *qs in con.execute(sql).fetchall() for p, q in zip((0.25, 0.75, 0.9), qs, strict=True)}
    for layout in (Layout("grouped"), Layout("sliced", limit=60), Layout("sliced", limit=5)):
        got = quantiles(df, ["x"], [0.25, 0.75, 0.9], by=["k"], layout=layout).collect()
        assert {(r["k"], r["prob"]): r["quantile"] for r in got} == want


def test_interpolation_of_extreme_values(spark):
    df = spark.createDataFrame([(1e308, 1.5e308), (float("-inf"), 1.0), (5e-324, 5e-324)], "a double, b double")
    got = [r[0] for r in df.select(between(df.a, df.b, F.lit(0.25))).collect()]
    assert got == [1.125e308, float("-inf"), pytest.approx(5e-324, abs=1e-323)]


def test_very_many_groups_are_sorted_and_not_searched(spark, monkeypatch):
    """Groups that end inside slices, that span several, that are null or have one hot value."""
    from tidegauge.operators import quantiles as module

    monkeypatch.setattr(module, "_searched", lambda *a: pytest.fail("one sketch per rank"))
    rng = np.random.default_rng(8)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 300, 6000), rng.integers(0, 900, 6000) / 8, strict=True)]
    rows += [(None, float(v)) for v in rng.normal(0, 1, 2000)] + [(-1, 7.0)] * 500 + [(-2, None)] * 3
    df = spark.createDataFrame(rows, "k bigint, x double").repartition(5)
    out = quantiles(df, ["x"], PROBS, by=["k"], layout=Layout("sliced", limit=5, slice_rows=64)).collect()
    have = {(r["k"], r["prob"]): r["quantile"] for r in out}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert have.keys() == {(k, p) for k in groups for p in PROBS}
    for (k, p), q in have.items():
        assert q == pytest.approx(np.quantile(groups[k], p), rel=1e-12)
