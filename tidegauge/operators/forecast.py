"""Simple forecasts of many series at once.

Every method here needs only the last values of a series, or the last levels of the smoothed series.
Those are taken per key (bounded, limited on the map side), kept as one array, and the forecast path is
an array expression over it. Levels are of the whole history; only values need no look at it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import c
from .order import AUTO, TIE, Layout, settle, tail_rows, with_ties
from .windows import smooth

# The forecast horizon limits, the interval factor.
MAX_STEPS, DEFAULT_STEPS = 168, 24
Z95 = 1.96


def check_steps(steps: int) -> int:
    if not 1 <= steps <= MAX_STEPS:
        raise ValueError(f"steps must be between 1 and {MAX_STEPS}")
    return steps


def tails(
    df: DataFrame,
    value: str,
    n: int,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
    alphas: Sequence[float] = (),
) -> DataFrame:
    """The last ``n`` non-null values of each key, oldest first, and the time of the last one.

    For each of ``alphas`` a further array has the levels of the smoothed series at these rows.
    """
    rows = with_ties(df.where(c(value).isNotNull()), keys, order)
    rows = rows.select(*[c(x) for x in dict.fromkeys([*keys, *order, value, TIE])])
    layout = settle(rows, keys, layout)
    for alpha in alphas:
        rows = smooth(rows, value, alpha, keys=keys, order=order, name=_level(alpha), layout=layout)
    last = tail_rows(rows, n, keys=keys, order=order, layout=layout)
    arrays = {"tail": value, **{_level(a): _level(a) for a in alphas}}
    entry = F.struct(
        *[c(o).alias(f"o{i}") for i, o in enumerate([*order, TIE])],
        *[c(x).cast("double").alias(f"x{i}") for i, x in enumerate(arrays.values())],
    )
    # At most n entries per key.
    got = last.groupBy(*[c(k) for k in keys]).agg(
        F.sort_array(F.collect_list(entry)).alias("__entries"), F.max(c(order[0])).alias("last_ts")
    )
    return got.select(
        *[c(k) for k in keys],
        *[_field("__entries", f"x{i}").alias(n) for i, n in enumerate(arrays)],
        "last_ts",
    )


def _field(entries: str, name: str) -> Column:
    return F.transform(entries, lambda e: e[name])


def _level(alpha: float) -> str:
    """Name of the array of levels; no dots in it."""
    return f"level_{alpha!r}".replace(".", "_")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _mean(xs: Column) -> Column:
    return F.try_divide(_total(xs), F.size(xs))


def _deviation(xs: Column, ddof: int) -> Column:
    m = _mean(xs)
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.sqrt(F.try_divide(squares, F.size(xs) - ddof))


def last_of(xs: Column, n: int) -> Column:
    """The last ``n`` elements, or all if there are fewer."""
    return F.slice(xs, F.greatest(F.size(xs) - n, F.lit(0)) + 1, F.lit(n))


def _repeat(level: Column, steps: int) -> Column:
    return F.array_repeat(level, steps)


def moving_average_path(tail: Column, steps: int, window: int = 24) -> Column:
    return _repeat(_mean(last_of(tail, window)), steps)


def weighted_average_path(
    tail: Column, steps: int, window: int = 24, weights: Sequence[float] | None = None
) -> Column:
    """Weighted mean of the last values, fed back step by step."""
    ws = [float(w) for w in (weights or range(1, window + 1))]
    if len(ws) != window or sum(ws) == 0:
        raise ValueError("need one weight per window row, with a sum other than zero")
    scaled = F.array(*[F.lit(w / sum(ws)) for w in ws])

    def step(state: Column, _i: Column) -> Column:
        new = _total(F.zip_with(last_of(state, window), scaled, lambda x, w: x * w))
        return F.concat(state, F.array(new))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), last_of(tail, window), step)
    return last_of(done, steps)


def seasonal_naive_path(tail: Column, steps: int, period: int = 24) -> Column:
    season = last_of(tail, period)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.get(season, (i % period).cast("int"))
    )


def smoothing_path(levels: Column, steps: int) -> Column:
    """The last level of the exponentially smoothed series, repeated."""
    return _repeat(F.element_at(levels, -1), steps)


@dataclass(frozen=True)
class Method:
    """A forecast method over tails: how far back it looks, the least rows, its path.

    With ``alpha`` the path is made of the smoothed series' levels in place of the values.
    """

    name: str
    reach: int
    minimum: int
    path: Callable[[Column, int], Column]
    alpha: float | None = None

    @property
    def source(self) -> str:
        """The array of ``tails`` that the path is made of."""
        return "tail" if self.alpha is None else _level(self.alpha)

    @property
    def alphas(self) -> list[float]:
        return [] if self.alpha is None else [self.alpha]


def moving_average(window: int = 24) -> Method:
    return Method(
        "moving_average", 2 * window, window, lambda t, h: moving_average_path(t, h, window)
    )


def weighted_moving_average(window: int = 24, weights: Sequence[float] | None = None) -> Method:
    return Method(
        "weighted_moving_average",
        window,
        window,
        lambda t, h: weighted_average_path(t, h, window, weights),
    )


def seasonal_naive(period: int = 24) -> Method:
    return Method(
        "seasonal_naive", period, period, lambda t, h: seasonal_naive_path(t, h, period)
    )


def exponential_smoothing(alpha: float = 0.3) -> Method:
    return Method("exponential_smoothing", 10, 10, smoothing_path, alpha)


def simple_methods(window: int = 24, alpha: float = 0.3, period: int = 24) -> list[Method]:
    return [
        moving_average(window),
        weighted_moving_average(window),
        seasonal_naive(period),
        exponential_smoothing(alpha),
    ]


AVAILABLE = (
    "moving_average",
    "weighted_moving_average",
    "seasonal_naive",
    "exponential_smoothing",
    "ensemble",
)


def _by_step(paths: DataFrame, keys: Sequence[str], columns: dict[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    """One row per step from arrays of equal length."""
    zipped = F.arrays_zip(*[e.alias(n) for n, e in columns.items()])
    return paths.select(
        *[c(k) for k in keys], *extra, F.posexplode(zipped).alias("__p", "__e")
    ).select(
        *[c(k) for k in keys],
        *extra,
        (F.col("__p") + 1).alias("step"),
        *[F.col(f"__e.{n}").alias(n) for n in columns],
    )


def forecast_paths(
    df: DataFrame,
    value: str,
    method: Method,
    steps: int = DEFAULT_STEPS,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """(keys…, step, forecast); series with too few values give no rows."""
    got = tails(df, value, method.reach, keys=keys, order=order, layout=layout, alphas=method.alphas)
    ready = got.where(F.size("tail") >= method.minimum).withColumn(
        "__path", method.path(F.col(method.source), check_steps(steps))
    )
    return _by_step(ready, keys, {"forecast": F.col("__path")})


def moving_average_forecast(
    df: DataFrame,
    value: str,
    window: int = 24,
    steps: int = DEFAULT_STEPS,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Mean of the last window, repeated, with a band of 1.96 sample deviations of two windows."""
    got = tails(df, value, 2 * window, keys=keys, order=order, layout=layout)
    ready = got.where(F.size("tail") >= window).withColumns(
        {
            "__path": moving_average_path(F.col("tail"), check_steps(steps), window),
            "__band": F.lit(Z95) * _deviation(F.col("tail"), 1),
        }
    )
    out = _by_step(ready, keys, {"forecast": F.col("__path")}, ["__band"])
    return out.withColumns(
        {
            "confidence_lower": F.col("forecast") - F.col("__band"),
            "confidence_upper": F.col("forecast") + F.col("__band"),
        }
    ).drop("__band")


def ensemble_forecast(
    df: DataFrame,
    value: str,
    steps: int = DEFAULT_STEPS,
    *,
    methods: Sequence[Method] | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Mean over the methods per step, with a band of 1.96 deviations between them.

    All methods read the same tail, so there is one pass over the data.
    """
    methods = list(methods or simple_methods())
    reach = max(m.reach for m in methods)
    least = max(m.minimum for m in methods)
    alphas = list(dict.fromkeys(a for m in methods for a in m.alphas))
    got = tails(df, value, reach, keys=keys, order=order, layout=layout, alphas=alphas)
    paths = got.where(F.size("tail") >= least).withColumns(
        {m.name: m.path(F.col(m.source), check_steps(steps)) for m in methods}
    )
    out = _by_step(paths, keys, {m.name: F.col(m.name) for m in methods})
    every = F.array(*[F.col(m.name) for m in methods])
    mean, band = _mean(every), F.lit(Z95) * _deviation(every, 0)
    return out.withColumns(
        {
            "forecast": mean,
            "confidence_lower": mean - band,
            "confidence_upper": mean + band,
        }
    )


def forecast(
    df: DataFrame,
    value: str,
    method: str = "ensemble",
    steps: int = DEFAULT_STEPS,
    *,
    window: int = 24,
    alpha: float = 0.3,
    period: int = 24,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """(keys…, step, forecast) by method name."""
    how = {"keys": keys, "order": order, "layout": layout}
    if method == "ensemble":
        out = ensemble_forecast(
            df, value, steps, methods=simple_methods(window, alpha, period), **how
        )
    elif method == "autoregressive":
        from .autoreg import autoregressive_forecast

        out = autoregressive_forecast(df, value, steps, **how)
    else:
        known = {m.name: m for m in simple_methods(window, alpha, period)}
        if method not in known:
            raise ValueError(f"unknown method: {method}; available: {[*AVAILABLE, 'autoregressive']}")
        out = forecast_paths(df, value, known[method], steps, **how)
    return out.select(*[c(k) for k in keys], "step", "forecast")


def timeline(
    df: DataFrame,
    value: str,
    method: str = "ensemble",
    steps: int = DEFAULT_STEPS,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    **options,
) -> DataFrame:
    """A forecast on the hours after the last row, labelled with target and method."""
    ahead = forecast(df, value, method, steps, keys=keys, order=order, **options)
    by = [c(k) for k in keys]
    if keys:
        last = df.groupBy(*by).agg(F.max(c(order[0])).alias("last_ts"))
        from ..columns import attach

        ahead = attach(ahead, last, keys)
    else:
        ahead = ahead.withColumn("last_ts", df.agg(F.max(c(order[0]))).scalar())
    return ahead.select(
        *by,
        "step",
        (F.col("last_ts") + F.make_dt_interval(hours=F.col("step"))).alias("ts"),
        F.lit(value).alias("target"),
        F.lit(method).alias("method"),
        "forecast",
    )
