"""Reading and writing readings: CSV, Parquet, time columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import c, ntz
from ..operators.order import AUTO, Layout, number_rows

# The columns of a readings file.
POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]
WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction"]
WEATHER_SHORT = ["TEMP", "PRES", "DEWP", "RAIN", "WSPM"]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def readings_schema(time: str = "datetime", values: Sequence[str] = (*POLLUTANTS, *WEATHER)) -> T.StructType:
    """Time as text, every value a nullable double."""
    fields = [T.StructField(time, T.StringType(), True)]
    return T.StructType(fields + [T.StructField(v, T.DoubleType(), True) for v in values])


def read_readings_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header and a given schema; empty cells and malformed numbers become NULL."""
    return (
        spark.read.schema(schema or readings_schema())
        .option("header", True)
        .option("nullValue", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite; with partition columns only the partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parsed_time(col: Column, fmt: str = TIME_FORMAT) -> Column:
    """Text to a timestamp without zone; NULL when it does not parse.

    The text is read as if in UTC and counted from the epoch, so hours that a session's own zone
    skips or repeats stay what they are.
    """
    read = F.try_to_timestamp(F.concat(col, F.lit(" +0000")), F.lit(f"{fmt} Z"))
    micros = F.unix_micros(read)
    whole = F.make_dt_interval(days=F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    rest = F.make_dt_interval(secs=F.pmod(micros, F.lit(86_400_000_000)).cast("decimal(18,6)") / 1_000_000)
    return F.lit("1970-01-01").cast("timestamp_ntz") + whole + rest


def with_time_column(
    df: DataFrame,
    name: str = "datetime",
    *,
    order: Sequence[str] = (),
    start: str = "2024-11-01 00:00:00",
    fmt: str = TIME_FORMAT,
    layout: Layout = AUTO,
) -> DataFrame:
    """Make sure there is a time column.

    Takes ``datetime`` if present, else ``date``, else counts hours from ``start`` in the order of
    the given columns (a file has no row order that a cluster could rely on).
    """

    def as_time(source: str) -> Column:
        kind = df.schema[source].dataType
        if isinstance(kind, T.StringType):
            return F.coalesce(parsed_time(c(source), fmt), parsed_time(c(source), "yyyy-MM-dd"))
        return ntz(c(source))

    for source in (name, "date"):
        if source in df.columns:
            return df.withColumn(name, as_time(source))
    if not order:
        raise ValueError("no time column: name the columns that give the row order")
    rows = number_rows(df, "__hour", order=order, layout=layout)
    # Days and hours apart: hours alone would not fit an int in a table of more than 2^31 rows.
    hour = F.col("__hour") - 1
    days, hours = F.floor(hour / 24).cast("int"), F.pmod(hour, F.lit(24)).cast("int")
    stamp = ntz(F.lit(start)) + F.make_dt_interval(days=days, hours=hours)
    return rows.withColumn(name, stamp).drop("__hour")
