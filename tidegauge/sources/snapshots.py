"""Snapshots of a processed table, kept as partitions named by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readings import write_parquet

# Fixed value: the form of a snapshot name.
NAME_FORMAT = "'processed_'yyyyMMdd_HHmmss"


def snapshot_name(stamp) -> str:
    """Name of the snapshot taken at a Python datetime; names sort by time."""
    return stamp.strftime("processed_%Y%m%d_%H%M%S")


def write_snapshot(df: DataFrame, folder: str, name: str) -> None:
    """Add or replace one snapshot; the others stay."""
    write_parquet(df.withColumn("snapshot", F.lit(name)), folder, partition_by=["snapshot"])


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the snapshot with the greatest name.

    The maximum over the partition column reads no data columns, and the filter prunes all other
    partitions before the scan.
    """
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("snapshot").alias("snapshot")).scalar()
    return rows.where(F.col("snapshot") == newest)


def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same for plain files ``processed_*.parquet`` side by side in one folder.

    The newest name is looked up first, so that the filter on it skips all other files.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
    named = rows.withColumn("snapshot", F.col("_metadata.file_name"))
    newest = named.agg(F.max("snapshot")).first()[0]
    return named.where(F.col("_metadata.file_name") == F.lit(newest))
