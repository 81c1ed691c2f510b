"""Lags, rolling values and other row-relative columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from math import ceil, log

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import c, hours_between
from ..functions.stats import pearson
from .order import AUTO, Layout, number_rows, over_rows, settle


def lags(
    df: DataFrame,
    values: Sequence[str],
    steps: Sequence[int] = (1, 24),
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    name: Callable[[str, int], str] = lambda v, k: f"{v}_lag_{k}",
    backfill: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """Earlier values of each column.

    ``backfill`` gives the leading rows, which have no lag, the first value of their series.
    """

    def add(w) -> dict[str, Column]:
        out = {}
        for v in values:
            for k in steps:
                lagged = F.lag(c(v), k).over(w)
                if backfill:
                    leading = F.lag(F.lit(1), k).over(w).isNull()
                    start = F.first(c(v)).over(w.rowsBetween(-k, 0))
                    lagged = F.when(leading, start).otherwise(lagged)
                out[name(v, k)] = lagged
        return out

    return over_rows(df, add, keys=keys, order=order, before=max(steps), layout=layout)


def rolling_mean(
    df: DataFrame,
    values: Sequence[str],
    rows: int = 24,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    min_periods: int = 1,
    centred: bool = False,
    name: Callable[[str, int], str] = lambda v, n: f"{v}_rolling_{n}",
    layout: Layout = AUTO,
) -> DataFrame:
    """Mean of the last ``rows`` rows (or of the rows around), if enough of them have a value."""
    back, ahead = ((rows - 1) // 2, rows // 2) if centred else (rows - 1, 0)

    def add(w) -> dict[str, Column]:
        frame = w.rowsBetween(-back, ahead)
        out = {}
        for v in values:
            mean = F.avg(c(v)).over(frame)
            if min_periods > 1:
                mean = F.when(F.count(c(v)).over(frame) >= min_periods, mean)
            out[name(v, rows)] = mean
        return out

    return over_rows(df, add, keys=keys, order=order, before=back, after=ahead, layout=layout)


def rolling_corr(
    df: DataFrame,
    value: str,
    rows: int = 24,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    name: str | None = None,
    layout: Layout = AUTO,
) -> DataFrame:
    """Correlation of the last ``rows`` values with the ``rows`` values before them."""
    name = name or f"{value}_corr_{rows}"

    def add(w) -> list[dict[str, Column]]:
        frame = w.rowsBetween(-(rows - 1), 0)
        y = F.col("__y")
        both = c(value).isNotNull() & y.isNotNull()
        x = F.when(both, c(value))
        spread = F.stddev_pop(x).over(frame) * F.stddev_pop(F.when(both, y)).over(frame)
        r = F.try_divide(F.covar_pop(x, y).over(frame), spread)
        return [
            {"__y": F.lag(c(value), rows).over(w)},
            {name: F.when(F.count(x).over(frame) == rows, r)},
        ]

    return over_rows(df, add, keys=keys, order=order, before=2 * rows - 1, layout=layout).drop("__y")


def gap_hours(
    df: DataFrame,
    ts: str,
    *,
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    name: str = "gap_hours",
    layout: Layout = AUTO,
) -> DataFrame:
    """Hours since the previous row; NULL on the first."""
    return over_rows(
        df,
        lambda w: {name: hours_between(c(ts), F.lag(c(ts), 1).over(w))},
        keys=keys,
        order=[ts, *tie],
        before=1,
        layout=layout,
    )


def percent_change(df: DataFrame, value: str, period: str, *, keys: Sequence[str] = (), name: str) -> DataFrame:
    """Change in percent against the row before; meant for a short table of periods."""
    before = F.lag(c(value), 1).over(Window.partitionBy(*[c(k) for k in keys]).orderBy(c(period)))
    return df.withColumn(name, F.try_divide(c(value) - before, before) * 100)


def direction_of_change(
    df: DataFrame,
    values: Sequence[str],
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    name: Callable[[str], str] = lambda v: f"{v}_direction",
    layout: Layout = AUTO,
) -> DataFrame:
    """Sign of the change since the previous row: -1, 0 or 1."""
    return over_rows(
        df,
        lambda w: {name(v): F.signum(c(v) - F.lag(c(v), 1).over(w)) for v in values},
        keys=keys,
        order=order,
        before=1,
        layout=layout,
    )


def supervised_windows(
    df: DataFrame,
    value: str,
    length: int = 24,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Training pairs: the ``length`` values before a row as an array, and its own value.

    Rows without a value are left out first, as the windows run over readings, not over hours.
    """
    rows = df.where(c(value).isNotNull())
    framed = over_rows(
        rows,
        lambda w: {"window": F.collect_list(c(value)).over(w.rowsBetween(-length, -1))},
        keys=keys,
        order=order,
        before=length,
        layout=layout,
    )
    return framed.where(F.size("window") == length).withColumn("label", c(value))


#: What a factor may grow to within a block, and where one is zero in double precision, as logarithms.
_GROWTH, _ZERO = 345.0, 745.2


def _decayed(rows: DataFrame, keys: Sequence[str], factor: float, layout: Layout, total: bool = False) -> DataFrame:
    """Add ``__s``: __x plus ``factor`` times the ``__s`` of the position ``__p`` before it.

    Positions count from 0 in each key. They are cut into blocks in which powers of the factor stay
    far from overflow, so that a sum over the block so far, scaled back, is the answer within the block.
    Only the last answer of a full block goes on, and those obey the same rule with a smaller factor.
    With ``total`` the series are known to fit one block.
    """
    size = _block(factor, layout)
    by = [c(k) for k in keys]
    block, place = F.expr(f"__p div {size}"), F.expr(f"__p % {size}")
    w = Window.partitionBy(*by, F.col("__b")).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(F.col("__x") * F.pow(F.lit(factor), -F.col("__i"))).over(w)
    inside = grown * F.pow(F.lit(factor), F.col("__i"))
    out = rows.withColumns({"__b": block, "__i": place}).withColumn("__s", inside)
    if total:
        return out.drop("__b", "__i")
    ends = out.where(F.col("__i") == size - 1).select(*by, F.col("__b").alias("__p"), F.col("__s").alias("__x"))
    whole = factor**size
    if -log(whole) > _GROWTH / 16:  # a few blocks on, nothing is left of a value
        terms = ceil(_ZERO / -log(whole))

        def add(w: WindowSpec) -> dict[str, Column]:
            older = [F.lit(whole**k) * F.lag("__x", k).over(w) for k in range(1, terms)]
            return {"__s": sum((F.coalesce(x, F.lit(0.0)) for x in older), F.col("__x"))}

        ends = over_rows(ends, add, keys=keys, order=["__p"], before=terms, layout=_fresh(layout))
    else:
        ends = _decayed(ends, keys, whole, layout)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    carried = ends.select(*[c(k).alias(n) for k, n in names.items()], (F.col("__p") + 1).alias("__to"), F.col("__s").alias("__from"))
    same = F.col("__b") == F.col("__to")
    for k, n in names.items():
        same = same & c(k).eqNullSafe(F.col(n))
    out = out.join(carried, same, "left").drop("__to", *names.values())
    earlier = F.pow(F.lit(factor), F.col("__i") + 1) * F.col("__from")
    return out.withColumn("__s", F.col("__s") + F.coalesce(earlier, F.lit(0.0))).drop("__b", "__i", "__from")


def _block(factor: float, layout: Layout) -> int:
    return max(1, min(layout.slice_rows, int(_GROWTH / -log(factor))))


def _fresh(layout: Layout) -> Layout:
    """The layout for another table: sizes are counted anew."""
    return replace(layout, how="auto" if layout.how == "sliced" else layout.how, largest=None, total=None)


def smooth(
    df: DataFrame,
    value: str,
    alpha: float = 0.3,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    name: str = "smoothed",
    layout: Layout = AUTO,
) -> DataFrame:
    """Exponentially smoothed series: s1 = x1, s = alpha·x + (1 - alpha)·previous s.

    Every earlier value counts, however small its weight. The recurrence is an affine map per row, and
    maps compose: rows are numbered, blocks of consecutive ones sum their weighted values, and what a
    block hands on is carried over the table of blocks. Rows without a value are left out first.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    rows = df.where(c(value).isNotNull())
    x = c(value).cast("double")
    if alpha == 1:
        return rows.withColumn(name, x)
    layout = settle(rows, keys, layout)
    rows = number_rows(rows, "__p", keys=keys, order=order, layout=layout)
    first = F.col("__p") == 1
    rows = rows.withColumn("__x", F.when(first, x).otherwise(alpha * x)).withColumn("__p", F.col("__p") - 1)
    short = layout.largest is not None and layout.largest <= _block(1 - alpha, layout)
    out = _decayed(rows, keys, 1 - alpha, layout, total=short)
    return out.withColumn(name, F.col("__s")).drop("__p", "__x", "__s")


def autocorrelation(
    df: DataFrame,
    value: str,
    steps: Sequence[int] = (1, 24, 168),
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    min_points: int = 0,
    min_pairs: int = 0,
    layout: Layout = AUTO,
) -> DataFrame:
    """Correlation with the own past: (keys…, lag, pairs, r), all lags in one aggregate.

    Rows without a value are left out first. Series with fewer than ``min_points`` points, and
    lags with no more than ``min_pairs`` pairs, are left out.
    """
    rows = df.where(c(value).isNotNull()).select(*[c(n) for n in dict.fromkeys([*keys, *order, value])])
    lagged = lags(
        rows, [value], steps, keys=keys, order=order, name=lambda v, k: f"__l{k}", layout=layout
    )
    x = c(value)
    wide = lagged.groupBy(*[c(k) for k in keys]).agg(
        F.count(x).alias("points"),
        *[F.count(F.col(f"__l{k}")).alias(f"__n{k}") for k in steps],
        *[pearson(x, F.col(f"__l{k}")).alias(f"__r{k}") for k in steps],
    )
    table = F.array(
        *[
            F.struct(
                F.lit(k).alias("lag"), F.col(f"__n{k}").alias("pairs"), F.col(f"__r{k}").alias("r")
            )
            for k in steps
        ]
    )
    return (
        wide.where(F.col("points") >= min_points)
        .select(*[c(k) for k in keys], "points", F.inline(table))
        .where(F.col("pairs") > min_pairs)
    )
