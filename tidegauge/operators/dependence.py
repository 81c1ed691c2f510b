"""Correlations between columns and through time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import attach, c, present
from ..functions.stats import direction, pearson, strength
from .order import AUTO, Layout, number_rows, settle
from .profiles import daily_means
from .windows import autocorrelation, rolling_corr, rolling_mean

# Lags of the full and of the wider autocorrelation report.
LAGS = (1, 24, 168)
LAGS_WIDE = (1, 6, 12, 24, 48, 72, 168)


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], names: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """All pair correlations in one aggregate with map-side combination, then one row per pair."""
    wide = df.groupBy(*[c(k) for k in keys]).agg(
        *[
            expr.alias(f"__{kind}{i}")
            for i, (a, b) in enumerate(pairs)
            for kind, expr in (
                ("r", pearson(c(a), c(b))),
                ("n", F.count(F.when(c(a).isNotNull() & c(b).isNotNull(), F.lit(1)))),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias(names[0]),
                F.lit(b).alias(names[1]),
                F.col(f"__r{i}").alias("r"),
                F.col(f"__n{i}").alias("n"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*[c(k) for k in keys], F.inline(rows))


def pair_correlations(
    df: DataFrame, values: Sequence[str], *, missing: str = "pairwise", keys: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every pair (a before b in ``values``): (a, b, r, n).

    ``listwise`` uses only rows where every column has a value, ``pairwise`` the rows where the
    two columns have one.
    """
    values = present(df, values)
    if len(values) < 2:
        raise ValueError("need at least 2 columns")
    if missing == "listwise":
        complete = F.lit(True)
        for v in values:
            complete = complete & c(v).isNotNull()
        df = df.where(complete)
    elif missing != "pairwise":
        raise ValueError(f"unknown missing: {missing}")
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    return _pairs(df, pairs, ("a", "b"), keys)


def correlation_matrix(pairs: DataFrame, values: Sequence[str]) -> DataFrame:
    """Long form of the full matrix: both triangles and the diagonal."""
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a"), F.col("b"), F.col("r")),
                F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")),
            )
        )
    )
    diagonal = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
    return both.unionByName(diagonal).where(F.col("a").isin(*values))


def to_wide(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long matrix to one row per ``a`` with a column per ``b``."""
    return matrix.groupBy("a").pivot("b", list(names)).agg(F.first("r"))


def to_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("b"), c(n).alias("r")) for n in names])
    return wide.select("a", F.inline(cells))


def notable_pairs(
    pairs: DataFrame, keep: float = 0.3, strong: float = 0.7
) -> DataFrame:
    """Pairs with |r| above ``keep``, labelled, strongest first."""
    r = F.col("r")
    return (
        pairs.where(F.abs(r) > keep)
        .withColumns(
            {"strength": strength(r, [(strong, "strong")], "moderate"), "direction": direction(r)}
        )
        .orderBy(F.abs(r).desc())
    )


def pair_summary(notable: DataFrame) -> DataFrame:
    """Counts of notable pairs, of strong, positive and negative ones, and the strongest pair."""
    r = F.col("r")
    best = F.min_by(F.struct("a", "b", "r"), F.struct(-F.abs(r), "a", "b"))  # among equals the first names
    return notable.agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(F.col("strength") == "strong").alias("strong_pairs"),
        F.count_if(r > 0).alias("positive_pairs"),
        F.count_if(r < 0).alias("negative_pairs"),
        best["a"].alias("strongest_a"),
        best["b"].alias("strongest_b"),
        best["r"].alias("strongest_r"),
    )


def covariate_correlations(
    df: DataFrame, values: Sequence[str], covariates: Sequence[str], *, keys: Sequence[str] = ()
) -> DataFrame:
    """Correlation of every value with every covariate: (value, covariate, r, n)."""
    values, covariates = present(df, values), present(df, covariates)
    if not values or not covariates:
        raise ValueError("need at least one value and one covariate")
    pairs = [(v, w) for v in values for w in covariates]
    return _pairs(df, pairs, ("value", "covariate"), keys).where(F.col("r").isNotNull())


def significant_covariates(rs: DataFrame, keep: float = 0.2, strong: float = 0.5) -> DataFrame:
    r = F.col("r")
    return (
        rs.where(F.abs(r) > keep)
        .withColumns(
            {"strength": strength(r, [(strong, "strong")], "moderate"), "direction": direction(r)}
        )
        .orderBy(F.abs(r).desc())
    )


def graded_covariates(rs: DataFrame, strong: float = 0.7, moderate: float = 0.4) -> DataFrame:
    """Every pair, labelled strong, moderate or weak."""
    r = F.col("r")
    return rs.withColumns(
        {
            "strength": strength(r, [(strong, "strong"), (moderate, "moderate")], "weak"),
            "direction": direction(r),
        }
    )


def covariate_impact(significant: DataFrame) -> DataFrame:
    """Per covariate: most affected value, its r, and how many pairs are positive or negative."""
    r = F.col("r")
    best = F.min_by(F.struct("value", "r"), F.struct(-F.abs(r), "value"))  # among equals the first name
    return significant.groupBy("covariate").agg(
        best["value"].alias("most_affected"),
        best["r"].alias("most_affected_r"),
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(r > 0).alias("positive"),
        F.count_if(r < 0).alias("negative"),
    )


def most_influential(impact: DataFrame) -> DataFrame:
    """The covariate with most significant pairs; the larger single effect decides a tie."""
    rank = F.struct(-F.col("pairs"), -F.abs(F.col("most_affected_r")), "covariate")
    return impact.agg(
        F.min_by("covariate", rank).alias("covariate"), F.max("pairs").alias("pairs")
    )


def rolling_corr_summary(
    df: DataFrame,
    value: str,
    windows: Sequence[int] = (24, 168),
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Mean, sample deviation, maximum and minimum of the rolling correlation per window length."""
    rows = df.where(c(value).isNotNull())
    layout = settle(rows, keys, layout)
    by = [c(k) for k in keys]
    out = None
    for n in windows:
        r = rolling_corr(rows, value, n, keys=keys, order=order, name="__r", layout=layout)
        one = r.groupBy(*by).agg(
            F.lit(n).alias("window"),
            F.avg("__r").alias("mean"),
            F.stddev_samp("__r").alias("std"),
            F.max("__r").alias("max"),
            F.min("__r").alias("min"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def decompose(
    days: DataFrame,
    value: str = "mean",
    day: str = "day",
    period: int = 7,
    *,
    keys: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """Additive decomposition of a short table of daily means into trend, seasonal and rest.

    Days without a value are left out and the rest is numbered on; the trend is the centred mean
    over one period (odd), the season the mean of the detrended values per phase, centred.
    """
    if period % 2 == 0:
        raise ValueError("period must be odd")
    by = [c(k) for k in keys]
    rows = days.where(c(value).isNotNull())
    rows = number_rows(rows, "rn", keys=keys, order=[day], layout=layout)
    rows = rolling_mean(
        rows, [value], period, keys=keys, order=[day], min_periods=period, centred=True,
        name=lambda v, n: "trend", layout=layout,
    ).withColumns({"detrended": c(value) - F.col("trend"), "phase": (F.col("rn") - 1) % period})
    # At most `period` rows per key.
    phases = rows.groupBy(*by, "phase").agg(F.avg("detrended").alias("phase_mean"))
    centre = phases.groupBy(*by).agg(F.avg("phase_mean").alias("centre"))
    seasonal = attach(phases, centre, keys).select(
        *by, "phase", (F.col("phase_mean") - F.col("centre")).alias("seasonal")
    )
    out = attach(rows, seasonal, [*keys, "phase"])
    return out.withColumn("rest", F.col("detrended") - F.col("seasonal")).drop(
        "detrended", "phase", "rn"
    )


def seasonal_strength(
    df: DataFrame,
    value: str,
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    min_points: int = 720,
    min_days: int = 30,
    layout: Layout = AUTO,
) -> DataFrame:
    """Weekly seasonal and trend strength of the daily means, for series that are long enough."""
    by = [c(k) for k in keys]
    rows = df.where(c(value).isNotNull())
    days = daily_means(rows, value, ts, keys=keys)
    parts = decompose(days, keys=keys, layout=layout)
    spread = F.stddev_pop("mean")
    strengths = parts.groupBy(*by).agg(
        F.try_divide(F.stddev_pop("seasonal"), spread).alias("seasonal_strength"),
        F.try_divide(F.stddev_pop("trend"), spread).alias("trend_strength"),
    )
    points = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))
    calendar_days = days.groupBy(*by).agg(F.count(F.lit(1)).alias("days"))
    sized = attach(attach(points, calendar_days, keys), strengths, keys)
    return sized.where((F.col("points") >= min_points) & (F.col("days") >= min_days)).withColumns(
        {
            "has_strong_seasonality": F.col("seasonal_strength") > 0.3,
            "has_strong_trend": F.col("trend_strength") > 0.3,
        }
    )


def persistence(lags: DataFrame, *, by: Sequence[str] = (), lag: int = 24) -> DataFrame:
    """Strongest absolute autocorrelation, and high/moderate/low by the r at ``lag``."""
    at = F.max(F.when(F.col("lag") == lag, F.col("r")))
    label = F.when(at > 0.5, "high").when(at > 0.2, "moderate").otherwise("low")
    return lags.groupBy(*[c(k) for k in by]).agg(
        F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("strongest_autocorrelation"),
        label.alias("persistence"),
    )


def persistence_of(df: DataFrame, values: Sequence[str], order: Sequence[str], layout: Layout) -> DataFrame:
    """One row per value, so that all values run as keys of one job."""
    cells = F.array(
        *[F.struct(F.lit(v).alias("variable"), c(v).cast("double").alias("__x")) for v in values]
    )
    long = df.select(*[c(o) for o in order], F.inline(cells))
    rs = autocorrelation(
        long, "__x", LAGS, keys=["variable"], order=order, min_points=48, min_pairs=10, layout=layout
    )
    return persistence(rs, by=["variable"])


def findings(
    df: DataFrame,
    values: Sequence[str],
    covariates: Sequence[str],
    ts: str = "datetime",
    *,
    tie: Sequence[str] = (),
    main: int = 3,
    missing: str = "listwise",
    layout: Layout = AUTO,
) -> DataFrame:
    """Key findings as text: strongest pair, most influential covariate, persistent values."""
    strongest = pair_summary(notable_pairs(pair_correlations(df, values, missing=missing)))
    r = F.col("strongest_r")
    pair_text = F.format_string(
        "Strongest correlation: %s and %s (%.3f, %s %s)",
        F.col("strongest_a"),
        F.col("strongest_b"),
        r,
        strength(r, [(0.7, "strong")], "moderate"),
        direction(r),
    )
    out = strongest.where(r.isNotNull()).select(
        F.lit("strongest_pair").alias("finding"), pair_text.alias("text")
    )
    if present(df, covariates):
        impact = covariate_impact(
            significant_covariates(covariate_correlations(df, values, covariates))
        )
        top = most_influential(impact).where(F.col("covariate").isNotNull())
        text = F.format_string(
            "Most influential weather factor: %s (affects %d pollutants)",
            F.col("covariate"),
            F.col("pairs"),
        )
        out = out.unionByName(
            top.select(F.lit("most_influential").alias("finding"), text.alias("text"))
        )
    first = present(df, values)[:main]
    high = persistence_of(df, first, [ts, *tie], layout).where(F.col("persistence") == "high")
    # At most one name per column of the table.
    listed = high.agg(F.sort_array(F.collect_list("variable")).alias("names"))
    text = F.concat(F.lit("High persistence pollutants: "), F.array_join("names", ", "))
    return out.unionByName(
        listed.where(F.size("names") > 0).select(F.lit("persistence").alias("finding"), text.alias("text"))
    )


def report(
    df: DataFrame,
    values: Sequence[str],
    covariates: Sequence[str],
    ts: str = "datetime",
    *,
    tie: Sequence[str] = (),
    main: int = 3,
    missing: str = "listwise",
    layout: Layout = AUTO,
) -> DataFrame:
    """The combined analysis as one tidy table: (section, a, b, r, label, direction)."""

    def section(name: str, frame: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
        return frame.select(
            F.lit(name).alias("section"),
            (F.col(a) if isinstance(a, str) else a).alias("a"),
            (F.col(b) if isinstance(b, str) else b).alias("b"),
            "r",
            F.col("strength").alias("label"),
            "direction",
        )

    pairs = notable_pairs(pair_correlations(df, values, missing=missing))
    out = section("pair", pairs, "a", "b")
    if present(df, covariates):
        rs = significant_covariates(covariate_correlations(df, values, covariates))
        out = out.unionByName(section("covariate", rs, "value", "covariate"))
    order = [ts, *tie]
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), c(v).cast("double").alias("__x"))
            for v in present(df, values)[:main]
        ]
    )
    long = df.select(*[c(o) for o in order], F.inline(cells))
    auto = autocorrelation(
        long, "__x", LAGS, keys=["variable"], order=order, min_points=48, min_pairs=10, layout=layout
    ).withColumns(
        {
            "strength": strength(F.col("r"), [(0.5, "high"), (0.2, "moderate")], "low"),
            "direction": direction(F.col("r")),
        }
    )
    lag_name = F.concat(F.lit("lag_"), F.col("lag").cast("string"), F.lit("h"))
    return out.unionByName(section("autocorrelation", auto, "variable", lag_name))
