"""Whole jobs: raw readings to a processed table, with or without validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..columns import present
from ..operators import clean as cleaning
from ..operators.features import add_features, add_light_features, feature_list
from ..operators.mlprep import fit_scaler, scale
from ..operators.order import AUTO, TIE, Layout, settle, with_ties
from ..operators.profiles import summary
from ..operators.quality import validate, verdict
from ..operators.select import final_columns
from ..session import cut
from ..sources.readings import (
    POLLUTANTS,
    TIME_FORMAT,
    read_csv_inferred,
    read_readings_csv,
    with_time_column,
    write_parquet,
)


class DataRejected(ValueError):
    """Raised when validation finds critical issues; ``report`` is the table of checks."""

    def __init__(self, report: DataFrame, counts) -> None:
        super().__init__(f"{counts['issues_count']} critical issues")
        self.report = report


def processed(
    df: DataFrame,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    fmt: str | None = None,
    features: Sequence[str] | None = None,
    fill: str = "lag_mean",
    layout: Layout = AUTO,
) -> tuple[DataFrame, list[str]]:
    """Cleaned, featured and scaled rows, and the features used.

    The featured rows are read twice (fitting the scaler, then transforming), and they stand on
    several cleaning passes, so they are written to the shared folder in between.
    """
    layout = settle(df, keys, layout)
    # One order of ties for all steps: what is brought together and sorted by key once then stays so.
    cleaned = cleaning.clean(
        with_ties(df, keys, [ts, *tie]), values, ts, keys=keys, tie=tie, fmt=fmt, fill=fill, layout=layout
    )
    featured = add_features(
        cleaned, ts, keys=keys, tie=tie, lagged=present(df, values)[:3], layout=layout
    )
    featured = cut(featured.drop(TIE), "featured")
    used = feature_list(featured, features)
    scaled = scale(featured, used, fit_scaler(featured, used))
    extra = [n for n in ("AQI", "scaled_features") if n in scaled.columns]
    return final_columns(scaled, [*keys, *present(df, values)], ts, extra), used


def _result(spark: SparkSession, output: str, values: Sequence[str], ts: str, features: int, layout: Layout) -> dict:
    saved = spark.read.parquet(output)
    kept = present(saved, values)
    return {
        "status": "success",
        "output_path": output,
        "record_count": saved.count(),
        "feature_count": features,
        "summary": summary(saved, kept, ts, layout=layout),
    }


def process_csv(
    spark: SparkSession,
    path: str,
    output: str,
    *,
    schema: T.StructType | None = None,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    features: Sequence[str] | None = None,
    layout: Layout = AUTO,
) -> dict:
    """CSV readings to a processed Parquet table; returns status, counts and the summary frame."""
    raw = read_readings_csv(spark, path, schema)
    rows, used = processed(
        raw, values, ts, keys=keys, tie=tie, fmt=TIME_FORMAT, features=features, layout=layout
    )
    write_parquet(rows, output)
    return _result(spark, output, values, ts, len(used), layout)


def light(
    df: DataFrame,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    backfill: bool = True,
    layout: Layout = AUTO,
) -> DataFrame:
    """The short way: fill forward then back, short feature set, rows with all core values."""
    df = with_time_column(df, ts, order=tie, layout=layout)
    layout = settle(df, keys, layout)
    known = present(df, values)
    others = [n for n in df.columns if n not in {*keys, *tie, ts}]
    filled = cleaning.ffill_bfill(df, others, keys=keys, order=[ts, *tie], layout=layout)
    featured = add_light_features(
        filled, known, ts, keys=keys, tie=tie, backfill=backfill, layout=layout
    )
    return cleaning.require_values(featured, known)


def process_csv_light(
    spark: SparkSession,
    path: str,
    output: str,
    *,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    layout: Layout = AUTO,
) -> dict:
    rows = light(read_csv_inferred(spark, path), values, ts, layout=layout)
    write_parquet(rows, output)
    return _result(spark, output, values, ts, len(rows.columns), layout)


def ingest(
    spark: SparkSession,
    path: str,
    output: str,
    *,
    source: str = "csv",
    schema: T.StructType | None = None,
    values: Sequence[str] = tuple(POLLUTANTS),
    ts: str = "datetime",
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> dict:
    """Validate, stop on critical issues, process, validate the result; ``source`` is csv or parquet.

    Both reports are saved beside the data, also when the input is rejected.
    """
    if source not in ("csv", "parquet"):
        raise ValueError(f"unknown source: {source}")
    raw = spark.read.parquet(path) if source == "parquet" else read_readings_csv(spark, path, schema)
    before = validate(raw, ts, required=values, keys=keys, tie=tie, layout=layout)
    write_parquet(before, f"{output.rstrip('/')}.input_report")
    before = spark.read.parquet(f"{output.rstrip('/')}.input_report")
    counts = verdict(before).first()
    if counts["has_critical_issues"]:
        raise DataRejected(before, counts)
    text_time = isinstance(raw.schema[ts].dataType, T.StringType)
    fmt = TIME_FORMAT if text_time else None
    rows, used = processed(raw, values, ts, keys=keys, tie=tie, fmt=fmt, layout=layout)
    write_parquet(rows, output)
    saved = spark.read.parquet(output)
    kept = [n for n in tie if n in saved.columns]
    after = validate(saved, ts, required=values, keys=keys, tie=kept, layout=layout)
    write_parquet(after, f"{output.rstrip('/')}.output_report")
    result = _result(spark, output, values, ts, len(used), layout)
    result["input_report"] = before
    result["output_report"] = spark.read.parquet(f"{output.rstrip('/')}.output_report")
    return result
