"""Feature vectors: assembled and standardised."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import c, require


@dataclass(frozen=True)
class Scaler:
    """Mean and sample deviation of each feature."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]


def _complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows where every feature has a value."""
    require(df, features)
    return df.where(reduce(lambda a, b: a & b, [c(f).isNotNull() for f in features]))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """One aggregate over the rows where all features have a value."""
    rows = _complete(df, features)
    stats = rows.agg(
        *[F.avg(c(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_samp(c(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    n = range(len(features))
    return Scaler(
        tuple(features),
        tuple(stats[f"m{i}"] or 0.0 for i in n),
        tuple(stats[f"s{i}"] or 0.0 for i in n),
    )


def scale(
    df: DataFrame,
    features: Sequence[str],
    scaler: Scaler | None = None,
    *,
    output: str = "scaled_features",
    as_vector: bool = False,
) -> DataFrame:
    """Add the standardised features (mean 0, sample deviation 1) as an array or an ML vector.

    Rows with a missing feature are dropped and a constant feature becomes 0, as in Spark ML; the
    arithmetic is plain column expressions and stays in generated code.
    """
    scaler = scaler or fit_scaler(df, features)
    parts = [
        (c(f).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        for f, m, s in zip(scaler.features, scaler.means, scaler.deviations, strict=True)
    ]
    vector = F.array(*parts)
    return _complete(df, scaler.features).withColumn(output, array_to_vector(vector) if as_vector else vector)


def ml_stages(features: Sequence[str], output: str = "scaled_features") -> Pipeline:
    """The same as Spark ML stages, for use in front of an ML model; names must not hold dots."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"),
            StandardScaler(inputCol="features", outputCol=output, withMean=True, withStd=True),
        ]
    )
