"""Lookups in a table of model runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Numeric parts of a version, so that 1.0.10 comes after 1.0.9."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(-1)))


def find_runs(
    runs: DataFrame,
    *,
    model_type: str | None = None,
    target: str | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Runs that match the type and the target and have any of the tags, newest first."""
    if model_type is not None:
        runs = runs.where(F.col("model_type") == model_type)
    if target is not None:
        runs = runs.where(F.col("target") == target)
    if tags is not None:
        runs = runs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
    return runs.orderBy(F.col("created_at").desc())


def latest_versions(runs: DataFrame, name: str | None = None) -> DataFrame:
    """The run with the greatest version of every model name (or of one)."""
    if name is not None:
        runs = runs.where(F.col("model_name") == name)
    key = F.struct(version_key(F.col("version")), F.col("created_at"))
    best = runs.groupBy("model_name").agg(
        F.max_by(F.struct(*runs.columns), key).alias("__row")
    )
    return best.select("__row.*")


def next_version(runs: DataFrame) -> DataFrame:
    """(model_name, next_version): the latest with its patch part raised, else ``.1`` appended."""
    parts = F.split("version", r"\.")
    patch = F.get(parts, F.lit(2)).try_cast("bigint")
    raised = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), (patch + 1).cast("string"))
    return latest_versions(runs).select(
        "model_name",
        F.when(patch.isNotNull(), raised)
        .otherwise(F.concat("version", F.lit(".1")))
        .alias("next_version"),
    )


#: Version of a model that has no run yet.
FIRST_VERSION = "1.0.0"


def safe_name(name: Column) -> Column:
    """Name with everything but letters, digits and underscores replaced by an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def run_id(model_type: Column, name: Column, created_at: Column) -> Column:
    """``type_name_yyyyMMdd_HHmmss``."""
    return F.concat_ws("_", model_type, safe_name(name), F.date_format(created_at, "yyyyMMdd_HHmmss"))
