from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import session
from tidegauge.operators import evaluate, select
from tidegauge.sources import history, readings, snapshots

CSV = """datetime,PM2.5,PM10,NO2,SO2,CO,O3,temperature,humidity,pressure,wind_speed,wind_direction
2024-11-15 00:00:00,17.25,31.5,12.75,4.5,0.625,88.25,-3.5,41.75,987.5,6.25,12.5
2024-11-15 01:00:00,,abc,14.125,3.25,0.75,91.5,-2.25,39.5,988.25,5.75,20.25
2024-11-15 02:00:00,250.5,310.5,15.5,2.75,0.875,95.25,-1.5,38.25,989.5,5.25,28.75
not a time,19.5,29.75,13.5,5.125,0.875,77.75,-1.75,44.25,989.75,7.5,33.75
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text(CSV)
    return str(path)


def test_given_schema_turns_bad_cells_into_nulls(spark, csv):
    df = readings.read_readings_csv(spark, csv)
    assert df.schema == readings.readings_schema()
    row = df.where("datetime = '2024-11-15 01:00:00'").first()
    assert row["PM2.5"] is None and row["PM10"] is None and row["NO2"] == 14.125
    assert df.count() == 4


def test_inferred_schema(spark, csv):
    kinds = {f.name: f.dataType for f in readings.read_csv_inferred(spark, csv).schema.fields}
    assert kinds["PM2.5"] == T.DoubleType() and kinds["PM10"] == T.StringType()


def test_time_column_choices(spark):
    df = spark.createDataFrame([("2024-01-02 03:00:00", "2023-01-01", 1)], "datetime string, date string, id int")
    assert readings.with_time_column(df).first()["datetime"] == datetime(2024, 1, 2, 3)
    assert readings.with_time_column(df.drop("datetime")).first()["datetime"] == datetime(2023, 1, 1)
    bare = df.drop("datetime", "date")
    assert readings.with_time_column(bare, order=["id"]).first()["datetime"] == datetime(2024, 11, 1)
    with pytest.raises(ValueError):
        readings.with_time_column(bare)


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snaps")
    early, late = (snapshots.snapshot_name(datetime(2024, 1, d, 7, 30)) for d in (9, 10))
    assert early == "processed_20240109_073000"
    df = spark.range(3).selectExpr("cast(id as double) AS `PM2.5`")
    snapshots.write_snapshot(df, folder, late)
    snapshots.write_snapshot(df.limit(1), folder, early)
    assert snapshots.latest_snapshot(spark, folder).count() == 3
    snapshots.write_snapshot(df.limit(2), folder, late)
    assert snapshots.latest_snapshot(spark, folder).count() == 2
    assert spark.read.parquet(folder).count() == 3


def test_latest_of_plain_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, values in (("processed_20240101_000000", [1, 2]), ("processed_20240301_000000", [3])):
        pq.write_table(pa.table({"x": values}), tmp_path / f"{name}.parquet")
    assert [r["x"] for r in snapshots.latest_file(spark, str(tmp_path)).collect()] == [3]


def test_history_round_trip(spark, tmp_path):
    rows = [("m", "PM2.5", i, float(a), float(a + i % 2)) for i, a in enumerate([1, 2, 4, 8])]
    df = spark.createDataFrame(rows, "model_name string, target string, i int, actual double, predicted double")
    scores = evaluate.metrics(df, by=["model_name", "target"], order=["i"])
    records = evaluate.to_history(scores, "model_name", "target", F.lit("2024-05-06 07:08:09"))
    history.save_history(records, str(tmp_path / "h"))
    back = history.load_history(spark, str(tmp_path / "h"))
    row = back.first()
    assert row["metrics"]["mae"] == 0.5 and row["timestamp"] == datetime(2024, 5, 6, 7, 8, 9)
    assert evaluate.best_model(back, "mae").first()["model_name"] == "m"
    assert evaluate.rank_models(back, "mae").first()["rank"] == 1


def test_shared_folder_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_folder(spark)
    assert folder == before if before else folder
    assert session.fresh_folder(spark, "x") != session.fresh_folder(spark, "x")


def test_cut_keeps_rows_and_names(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, `PM2.5` double, s string")
    again = session.cut(df)
    assert again.collect() == df.collect() and again.columns == df.columns
    assert session.cut(df.limit(0)).count() == 0
    assert session.release(spark) >= 2 and session.release(spark) == 0


def test_row_operators_run_on_a_stream(spark, tmp_path, csv):
    """Parsing, indices, rules and alerts hold no state, so they take a growing folder as they are."""
    from tidegauge.functions.rules import with_violations
    from tidegauge.operators.features import add_air_quality
    from tidegauge.operators.select import parse_ts

    stream = (
        spark.readStream.schema(readings.readings_schema())
        .option("header", True)
        .option("nullValue", "")
        .csv(str(tmp_path))
    )
    rows = add_air_quality(with_violations(parse_ts(stream)))
    running = rows.writeStream.format("memory").queryName("alerts").outputMode("append").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    got = spark.sql("SELECT datetime, level, alert, violations FROM alerts ORDER BY datetime").collect()
    assert [(r["datetime"].hour, r["level"], r["alert"]) for r in got] == [
        (0, "Moderate", "ok"),
        (1, "Good", "ok"),
        (2, "Unhealthy", "alert"),
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("1890-01-01 00:00:01",), ("x",)], "t string")
    want = ["2024-03-10 02:30:00", "1890-01-01 00:00:01", None]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(readings.parsed_time(F.col("t")).cast("string")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hours_of_very_long_tables(spark):
    row = F.lit(2**31 + 24).cast("long")
    days, hours = F.floor((row - 1) / 24).cast("int"), F.pmod(row - 1, F.lit(24)).cast("int")
    assert spark.range(1).select(F.make_dt_interval(days=days, hours=hours)).first()[0].days == (2**31 + 23) // 24


def test_ends_are_compared_as_times(spark):
    df = spark.createDataFrame([(1,)], "i int").select(F.lit("2024-01-05").cast("timestamp_ntz").alias("ts"))
    with pytest.raises(ValueError):
        select.between_ts(df, "ts", "2024-01-05 23:00", "2024-01-05T01:00")
