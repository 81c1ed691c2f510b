"""Evaluation history as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("statistics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def save_history(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str, schema: T.StructType = HISTORY_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
