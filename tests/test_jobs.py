from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest

from tidegauge.operators.order import Layout
from tidegauge.plans import jobs
from tidegauge.sources.readings import POLLUTANTS, WEATHER, readings_schema, write_parquet

ROWS = 120


def raw_rows(text: bool = True):
    out = []
    for i in range(ROWS):
        t = datetime(2024, 1, 1) + timedelta(hours=i)
        pollutants = [30 + 10 * math.sin(i / 4 + j) + (i * 7 % 5) for j in range(6)]
        weather = [10 + i % 7, 50 + i % 11, 1000 + i % 5, 2 + i % 3, float(i % 360)]
        if i == 50:
            pollutants[0] = None
        out.append((t.strftime("%Y-%m-%d %H:%M:%S") if text else t, *pollutants, *map(float, weather)))
    return out


@pytest.fixture(scope="module")
def csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "readings")
    spark.createDataFrame(raw_rows(), readings_schema()).write.option("header", True).csv(path)
    return path


@pytest.mark.parametrize("layout", [Layout(), Layout("sliced", slice_rows=30, limit=30)], ids=["plain", "sliced"])
def test_csv_to_processed_table(spark, csv, tmp_path, layout):
    out = str(tmp_path / "processed")
    result = jobs.process_csv(spark, csv, out, layout=layout)
    saved = spark.read.parquet(out)
    assert result["status"] == "success" and result["output_path"] == out
    assert saved.columns == ["datetime", *POLLUTANTS, "AQI", "scaled_features"]
    # The first day has no 24-hour lag and goes, everything else stays.
    assert result["record_count"] == saved.count() == ROWS - 24
    assert result["feature_count"] == 22 == len(saved.first()["scaled_features"])
    stats = {r["variable"]: r for r in result["summary"].collect()}
    assert set(stats) == set(POLLUTANTS) and stats["CO"]["null_count"] == 0
    sums = [0.0] * 22
    for r in saved.collect():
        sums = [a + b for a, b in zip(sums, r["scaled_features"], strict=True)]
    assert sums == pytest.approx([0.0] * 22, abs=1e-9)


def test_light_job_keeps_every_row(spark, csv, tmp_path):
    out = str(tmp_path / "light")
    result = jobs.process_csv_light(spark, csv, out)
    saved = spark.read.parquet(out)
    assert result["record_count"] == ROWS
    assert saved.where("`PM2.5` IS NULL OR `PM2.5_lag1` IS NULL").count() == 0
    first = saved.orderBy("datetime").first()
    assert first["PM2.5_lag1"] == first["PM2.5"] and first["day_of_week"] == 0


def test_ingest_saves_both_reports(spark, csv, tmp_path):
    out = str(tmp_path / "ok")
    result = jobs.ingest(spark, csv, out)
    assert result["record_count"] == ROWS - 24
    for part in ("input_report", "output_report"):
        assert spark.read.parquet(f"{out}.{part}").where("severity = 'issue'").count() == 0
        assert result[part].count() > 20


def test_ingest_refuses_bad_data(spark, tmp_path):
    source, out = str(tmp_path / "bad"), str(tmp_path / "out")
    rows = [(r[0], -5.0, *r[2:]) for r in raw_rows(text=False)]
    names = ["datetime", *POLLUTANTS, *WEATHER]
    schema = "datetime timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names[1:])
    write_parquet(spark.createDataFrame(rows, schema), source)
    with pytest.raises(jobs.DataRejected, match="1 critical issues") as caught:
        jobs.ingest(spark, source, out, source="parquet")
    bad = caught.value.report.where("severity = 'issue'").first()
    assert bad["column"] == "PM2.5" and bad["value"] == ROWS
    assert not (tmp_path / "out").exists() and (tmp_path / "out.input_report").exists()


def test_keys_stay_apart(spark):
    rows = [(k, t, *(v if v is None else v + off for v in rest)) for k, off in (("a", 0), ("b", 1)) for t, *rest in raw_rows(text=False)]
    schema = "k string, datetime timestamp_ntz, " + ", ".join(f"`{n}` double" for n in [*POLLUTANTS, *WEATHER])
    df = spark.createDataFrame(rows, schema).repartition(4)
    out, _ = jobs.processed(df, keys=["k"])
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": ROWS - 24, "b": ROWS - 24}
    # The gap at row 50 takes the row before it of the same key.
    gap = datetime(2024, 1, 1) + timedelta(hours=50)
    got = {r["k"]: r["PM2.5"] for r in out.where(out.datetime == gap).collect()}
    before = raw_rows(text=False)[49][1]
    assert got == {"a": pytest.approx(before), "b": pytest.approx(before + 1)}


def test_ingest_with_keys(spark, tmp_path):
    source, out = str(tmp_path / "keyed"), str(tmp_path / "out")
    rows = [(k, *r) for k in ("a", "b") for r in raw_rows(text=False)]
    schema = "k string, datetime timestamp_ntz, " + ", ".join(f"`{n}` double" for n in [*POLLUTANTS, *WEATHER])
    write_parquet(spark.createDataFrame(rows, schema), source)
    with pytest.raises(jobs.DataRejected):
        jobs.ingest(spark, source, out, source="parquet")
    result = jobs.ingest(spark, source, out, source="parquet", keys=["k"])
    assert result["record_count"] == 2 * (ROWS - 24)
    with pytest.raises(ValueError):
        jobs.ingest(spark, source, out, source="orc")
