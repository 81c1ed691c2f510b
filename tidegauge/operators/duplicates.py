"""Counting full copies of rows without moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import hashable


def copy_counts(df: DataFrame) -> tuple[int, int]:
    """(rows, rows that repeat an earlier row), exact.

    The first pass shuffles one 8-byte hash per row. Rows whose hash occurs once have no copy; only
    the others are moved by their hash and compared in full, so a collision cannot count as a copy.
    A hash that a third of the rows share is split over tasks by the join.
    """
    names = [f"__c{i}" for i in range(len(df.columns))]
    plain = df.select(*[hashable(df, n).alias(x) for n, x in zip(df.columns, names, strict=True)])
    hashed = plain.withColumn("__h", F.xxhash64(*names) if names else F.lit(0).cast("bigint"))
    hashes = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    seen = hashes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated")
    ).first()
    if not seen["repeated"]:
        return seen["rows"], 0
    repeated = hashes.where(F.col("n") > 1).select("__h")
    suspects = hashed.join(repeated, "__h", "left_semi")
    counted = suspects.groupBy("__h", *names).agg(F.count(F.lit(1)).alias("__copies"))
    return seen["rows"], counted.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0))).first()[0]
