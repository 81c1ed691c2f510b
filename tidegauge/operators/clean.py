"""Gap filling, outlier removal, de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c, hashable, present, quoted
from ..session import cut
from .order import AUTO, TIE, Layout, fill_gaps, over_rows, settle
from .quantiles import quantiles
from .select import parse_ts


def fill_previous(
    df: DataFrame,
    values: Sequence[str],
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    limit: int = 1,
    layout: Layout = AUTO,
) -> DataFrame:
    """NULL takes the nearest original value at most ``limit`` rows back."""

    def nearest(w) -> dict[str, Column]:
        return {
            v: F.coalesce(c(v), *[F.lag(c(v), k).over(w) for k in range(1, limit + 1)]) for v in values
        }

    return over_rows(df, nearest, keys=keys, order=order, before=limit, layout=layout)


def column_means(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The mean of each column, of each key if there are keys, as ``__m0``, ``__m1``, …"""
    means = [F.avg(c(v)).alias(f"__m{i}") for i, v in enumerate(values)]
    return df.groupBy(*[c(k) for k in keys]).agg(*means)


def fill_mean(
    df: DataFrame,
    values: Sequence[str],
    means: Mapping[str, float | None] | None = None,
    *,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Remaining NULLs take the mean of the column over the series (its key, or the table), or the given one.

    One aggregate for all columns. Without keys it comes in as a scalar; with keys it is joined back
    by key, and NULL keys are a series of their own. A series without any value keeps its NULLs.
    """
    if not values:
        return df
    if means is not None:
        return df.withColumns({v: F.coalesce(c(v), F.lit(means[v]).cast("double")) for v in values})
    with_means = attach(df, column_means(df, values, keys), keys)
    filled = {v: F.coalesce(c(v), F.col(f"__m{i}")) for i, v in enumerate(values)}
    return with_means.withColumns(filled).drop(*[f"__m{i}" for i in range(len(values))])


def ffill(df: DataFrame, values: Sequence[str], **how) -> DataFrame:
    """NULL takes the nearest earlier value, however far."""
    return fill_gaps(df, values, how="forward", **how)


def bfill(df: DataFrame, values: Sequence[str], **how) -> DataFrame:
    """NULL takes the nearest later value, however far."""
    return fill_gaps(df, values, how="back", **how)


def ffill_bfill(df: DataFrame, values: Sequence[str], **how) -> DataFrame:
    return fill_gaps(df, values, how="both", **how)


def iqr_bounds(
    df: DataFrame, values: Sequence[str], k: float = 1.5, *, approx: bool = False, layout: Layout = AUTO
) -> dict[str, tuple[float, float]]:
    """[Q1 - k·IQR, Q3 + k·IQR] of each column that has values: two numbers per column."""
    rows = quantiles(df, values, [0.25, 0.75], approx=approx, layout=layout).collect()
    got = {(r["variable"], r["prob"]): r["quantile"] for r in rows}
    out = {}
    for v in values:
        q1, q3 = got.get((v, 0.25)), got.get((v, 0.75))
        if q1 is not None and q3 is not None:
            out[v] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def _keyed_bounds(
    df: DataFrame, values: Sequence[str], k: float, keys: Sequence[str], approx: bool, layout: Layout
) -> DataFrame:
    """Per key the bounds of each column, as ``__lo0``, ``__hi0``, …"""
    long = quantiles(df, values, [0.25, 0.75], by=keys, approx=approx, layout=layout)

    def one(v: str, p: float) -> Column:
        return F.max(F.when((F.col("variable") == v) & (F.col("prob") == p), F.col("quantile")))

    wide = long.groupBy(*[c(n) for n in keys]).agg(
        *[one(v, p).alias(f"__q{i}{e}") for i, v in enumerate(values) for e, p in (("a", 0.25), ("b", 0.75))]
    )
    out = [c(n) for n in keys]
    for i in range(len(values)):
        low, high = F.col(f"__q{i}a"), F.col(f"__q{i}b")
        out.append((low - k * (high - low)).alias(f"__lo{i}"))
        out.append((high + k * (high - low)).alias(f"__hi{i}"))
    return wide.select(*out)


def iqr_filter(
    df: DataFrame,
    values: Sequence[str],
    k: float = 1.5,
    *,
    keys: Sequence[str] = (),
    mode: str = "sequential",
    approx: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """Keep rows inside the bounds of every column; a NULL value drops the row.

    ``sequential`` takes the bounds of a column from the rows that earlier columns left, ``joint``
    takes all bounds from the input in one pass. With keys every series has bounds of its own, joined
    back by key; otherwise bounds are literals, so the filter can be pushed into the scan. A column
    without any value (in the series) is skipped.
    """
    if mode not in ("sequential", "joint"):
        raise ValueError(f"unknown mode: {mode}")
    if not approx:
        layout = settle(df, keys, layout)
    for batch in [[v] for v in values] if mode == "sequential" else [list(values)]:
        if keys:
            bounded = attach(df, _keyed_bounds(df, batch, k, keys, approx, layout), keys)
            for i, v in enumerate(batch):
                low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
                bounded = bounded.where(low.isNull() | c(v).between(low, high))
            df = bounded.drop(*[f"__{e}{i}" for i in range(len(batch)) for e in ("lo", "hi")])
            continue
        for v, (low, high) in iqr_bounds(df, batch, k, approx=approx, layout=layout).items():
            df = df.where(c(v).between(low, high))
    return df


def _without_outliers(
    df: DataFrame, values: Sequence[str], keys: Sequence[str], by_mean: bool, mode: str, k: float
) -> DataFrame:
    """``fill_mean`` if wanted, then ``iqr_filter``, for series that fit one task.

    Means and quartiles are windows over the whole series, so rows that the step before has brought
    together by key stay where they are, and no step is run again for the one after it.
    """
    if mode not in ("sequential", "joint"):
        raise ValueError(f"unknown mode: {mode}")
    series = Window.partitionBy(*[c(n) for n in keys])
    if by_mean:
        df = df.withColumns({v: F.coalesce(c(v), F.avg(c(v)).over(series)) for v in values})
    quarters = F.array(F.lit(0.25), F.lit(0.75))
    for batch in [[v] for v in values] if mode == "sequential" else [list(values)]:
        df = df.withColumns(
            {f"__q{i}": F.percentile(c(v).cast("double"), quarters).over(series) for i, v in enumerate(batch)}
        )
        for i, v in enumerate(batch):
            low, high = (F.get(f"__q{i}", F.lit(j)) for j in (0, 1))
            df = df.where(low.isNull() | c(v).between(low - k * (high - low), high + k * (high - low)))
        df = df.drop(*[f"__q{i}" for i in range(len(batch))])
    return df


def dedupe_ts(
    df: DataFrame, ts: str, *, keys: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """One row per timestamp and key: the first by ``tie`` (all other columns by default).

    Spark limits each group to one row on the map side, so many copies of one stamp stay cheap.
    """
    by = [*keys, ts]
    order = [hashable(df, n) for n in (tie or [n for n in df.columns if n not in {*by, TIE}])] or [F.lit(1)]
    w = Window.partitionBy(*[c(b) for b in by]).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def require_values(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of the known columns."""
    known = present(df, values)
    return df.dropna(subset=[quoted(v) for v in known]) if known else df


def clean(
    df: DataFrame,
    values: Sequence[str],
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    fill: str = "lag_mean",
    iqr_mode: str = "sequential",
    k: float = 1.5,
    fmt: str | None = None,
    per_key: bool = True,
    layout: Layout = AUTO,
) -> DataFrame:
    """Parse time, fill gaps, drop outliers, keep one row per timestamp.

    With keys each series is cleaned by itself, with its own means and bounds; ``per_key=False``
    takes means and bounds over the whole table. ``fmt`` parses a text time column; leave it out when
    the column already is a timestamp.
    """
    if fill not in ("lag_mean", "ffill_bfill"):
        raise ValueError(f"unknown fill: {fill}")
    values = present(df, values)
    df = parse_ts(df, ts, fmt) if fmt else df.where(c(ts).isNotNull())
    layout = settle(df, keys, layout)
    series = {"keys": keys, "order": [ts, *tie], "layout": layout}
    if keys and per_key and layout.how == "grouped":
        df = fill_previous(df, values, **series) if fill == "lag_mean" else ffill_bfill(df, values, **series)
        df = _without_outliers(df, values, keys, fill == "lag_mean", iqr_mode, k)
        return dedupe_ts(df, ts, keys=keys, tie=tie)
    own = keys if per_key else ()
    # The filled rows are written once: the means and every column's bounds are read from them.
    if fill == "lag_mean":
        df = cut(fill_previous(df, values, **series), "filled")
        df = fill_mean(df, values, keys=own)
    else:
        df = cut(ffill_bfill(df, values, **series), "filled")
    # Bounds over the whole table need a check of their own: the one per key says nothing about them.
    how = layout if per_key or not keys else replace(layout, how="auto", largest=None, total=None)
    df = iqr_filter(df, values, k, keys=own, mode=iqr_mode, layout=how)
    return dedupe_ts(df, ts, keys=keys, tie=tie)
