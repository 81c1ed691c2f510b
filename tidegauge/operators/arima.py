"""Seasonal ARIMA models of many series at once, fitted by two linear regressions.

A moving-average term needs the innovations of the past, which are not observed. A long autoregression,
fitted per series first, gives them; they then stand as lagged regressors beside the lagged values. Both
regressions need only means and covariances, which are ordinary aggregates with map-side combination, so
nothing of a series but its moments is ever in one place, and two orderings of the table are all it costs.

The small normal equations are solved in array expressions of any size (``solve``); all orders of the grid
are tried in one expression over the table of moments, and each series keeps the one of least AIC. As in
``autoreg``, levels stand as the level before and changes, which stay well conditioned.

Seasonal terms stand at the lag ``period`` beside the others (an additive seasonal model); seasonal
differences are taken beforehand and put back into the forecast.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..columns import attach, c
from .autoreg import MIN_POINTS
from .forecast import DEFAULT_STEPS, _by_step, check_steps
from .order import AUTO, TIE, Layout, fill_gaps, over_rows, settle, tail_rows, with_places, with_ties

#: Lags of the long autoregression.
LONG = 8
# The grid of orders and the seasonal period.
MAX_ORDER, PERIOD = (2, 1, 2), 24

#: Regressors and targets, by their place in the moments.
_TERMS = ["before", "change1", "change2", "shock1", "shock2", "season", "season_change", "season_shock", "change", "level"]
_CHANGE, _LEVEL = _TERMS.index("change"), _TERMS.index("level")


def solve(matrix: Column, right: Column) -> Column:
    """The solution of a symmetric positive definite system, an array; NULL in it unless it is unique.

    ``matrix`` is an array of rows. Rows and columns are scaled to a unit diagonal, so that a pivot tells
    how much of a column the ones before it leave unexplained.
    """
    scale = F.transform(matrix, lambda row, i: F.sqrt(F.get(row, i)))

    def scaled(row: Column, i: Column) -> Column:
        own = F.zip_with(row, scale, lambda x, s: F.try_divide(x, s * F.get(scale, i)))
        return F.concat(own, F.array(F.try_divide(F.get(right, i), F.get(scale, i))))

    def eliminate(m: Column, i: Column) -> Column:
        pivot = F.get(F.get(m, i), i)
        line = F.transform(F.get(m, i), lambda x: F.when(pivot > 1e-10, x / pivot))
        return F.transform(
            m, lambda row, r: F.when(r == i, line).otherwise(F.zip_with(row, line, lambda x, y: x - F.get(row, i) * y))
        )

    places = F.transform(matrix, lambda _, i: i)
    done = F.aggregate(places, F.transform(matrix, scaled), eliminate)
    return F.transform(done, lambda row, i: F.element_at(row, -1) / F.get(scale, i))


def _dot(xs: Column, ys: Column) -> Column:
    return F.aggregate(F.zip_with(xs, ys, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def _moments(terms: dict[str, Column], whole: Column) -> list[Column]:
    """``n``, the array ``mean`` and the rows ``cov`` of covariances of the terms, over the whole rows."""
    xs = [F.when(whole, e) for e in terms.values()]
    cov = {(i, j): F.covar_pop(xs[i], xs[j]) for i in range(len(xs)) for j in range(i + 1)}
    rows = [F.array(*[cov[max(i, j), min(i, j)] for j in range(len(xs))]) for i in range(len(xs))]
    return [F.count_if(whole).alias("n"), F.array(*[F.avg(x) for x in xs]).alias("mean"), F.array(*rows).alias("cov")]


def _fit(idx: Column, target: Column, n: Column, floor: Column) -> tuple[Column, Column, Column]:
    """Coefficients, constant and variance of the target on the terms ``idx``, from ``mean`` and ``cov``."""
    cov, mean = F.col("cov"), F.col("mean")

    def at(i: Column, j: Column) -> Column:
        return F.get(F.get(cov, i), j)

    right = F.transform(idx, lambda i: at(i, target))
    beta = solve(F.transform(idx, lambda i: F.transform(idx, lambda j: at(i, j))), right)
    const = F.get(mean, target) - _dot(beta, F.transform(idx, lambda i: F.get(mean, i)))
    return beta, const, F.greatest(at(target, target) - _dot(beta, right), floor)


def orders(period: int | None = None, most: tuple[int, int, int] = MAX_ORDER) -> list[tuple[int, ...]]:
    """(p, d, q, P, Q) of the grid; without a period P and Q are 0."""
    seasonal = [(0, 0), (1, 0), (0, 1), (1, 1)] if period else [(0, 0)]
    return [(*o, *s) for o in product(*[range(x + 1) for x in most]) for s in seasonal]


def _regressors(p: int, d: int, q: int, sp: int, sq: int) -> list[str]:
    """A level model of order p is the change on the level before and on p - 1 changes before."""
    own = ["change1", "change2"][:p] if d else ["before", "change1"][:p]
    season = ["season_change" if d else "season"][:sp]
    return [*own, *["shock1", "shock2"][:q], *season, *["season_shock"][:sq]]


def _grid(candidates: Sequence[tuple[int, ...]]) -> Column:
    def one(order: tuple[int, ...]) -> Column:
        idx = [F.lit(_TERMS.index(x)) for x in _regressors(*order)]
        names = dict(zip(("p", "d", "q", "sp", "sq"), order, strict=True))
        target = _LEVEL if order[0] == order[1] == 0 else _CHANGE
        fields = [F.lit(v).alias(k) for k, v in names.items()]
        return F.struct(*fields, F.lit(target).alias("target"), F.array(*idx).cast("array<int>").alias("idx"))

    return F.array(*[one(x) for x in candidates])


def _best(candidates: Sequence[tuple[int, ...]]) -> Column:
    """The fit of least AIC; among equals the smaller orders."""
    n = F.col("n").cast("double")
    level = F.get(F.get(F.col("cov"), F.lit(_LEVEL)), F.lit(_LEVEL))
    # A perfect fit would have no logarithm: stop at the rounding noise of the level.
    floor = F.lit(1e-14) * level + F.lit(1e-300)

    def fit(order: Column) -> Column:
        beta, const, variance = _fit(order["idx"], order["target"], n, floor)
        aic = n * F.ln(variance) + 2 * (F.size(order["idx"]) + 1)
        names = [order[x].alias(x) for x in ("p", "d", "q", "sp", "sq", "target", "idx")]
        return F.struct(aic.alias("aic"), *names, const.alias("const"), beta.alias("beta"), (n * variance).alias("rss"))

    fits = F.transform(_grid(candidates), fit)
    return F.array_min(F.filter(fits, lambda x: x["aic"].isNotNull() & ~F.exists(x["beta"], F.isnull)))


def _series(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], layout: Layout
) -> DataFrame:
    """The rows with ``__level``, gaps filled; they carry their places for the steps over them."""
    rows = with_ties(df, keys, order).select(*[c(n) for n in dict.fromkeys([*keys, *order, value, TIE])])
    rows = with_places(rows, keys, order, layout)
    rows = fill_gaps(rows, [value], keys=keys, order=order, how="both", layout=layout)
    return rows.where(c(value).isNotNull()).withColumn("__level", c(value).cast("double"))


def _difference(w: WindowSpec, season: int) -> dict[str, Column]:
    """``__y``, the level or its seasonal difference, which the first rows do not have."""
    return {"__y": F.col("__level") - F.lag("__level", season).over(w) if season else F.col("__level")}


def _past(k: int) -> str:
    return f"__l{k}"


def _lagged(w: WindowSpec, steps: Sequence[int]) -> dict[str, Column]:
    return {_past(k): F.lag("__y", k).over(w) for k in steps}


def _changes() -> dict[str, Column]:
    """Terms of the long autoregression, the target last."""
    level = [F.col("__y"), *[F.col(_past(k)) for k in range(1, LONG + 1)]]
    return {"before": level[1], **{f"change{k}": level[k] - level[k + 1] for k in range(1, LONG)}, "change": level[0] - level[1]}


def _fitted(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], period: int | None, season: int,
    candidates: Sequence[tuple[int, ...]], layout: Layout,
) -> tuple[DataFrame, DataFrame]:
    """The best fit of each series, and its rows with ``__y`` and the innovations ``__e``."""
    layout = settle(df, keys, layout)
    how = {"keys": keys, "order": order, "layout": layout}
    rows = _series(df, value, keys, order, layout)
    by = [c(k) for k in keys]
    lagged = over_rows(
        rows, lambda w: [_difference(w, season), _lagged(w, range(1, LONG + 1))], before=season + LONG, **how
    ).where("__y IS NOT NULL")
    long = lagged.groupBy(*by).agg(*_moments(_changes(), F.col(_past(LONG)).isNotNull()))
    idx = F.array(*[F.lit(i) for i in range(LONG)])
    beta, const, _ = _fit(idx, F.lit(LONG), F.col("n"), F.lit(0.0))
    long = long.select(*by, beta.alias("__beta"), const.alias("__const"))

    terms = _changes()
    inputs = F.array(*list(terms.values())[:LONG])
    e = terms["change"] - F.col("__const") - _dot(F.col("__beta"), inputs)
    shocks = {"shock1": 1, "shock2": 2, **({"season_shock": period} if period else {})}
    far = [period, period + 1] if period else []
    steps = sorted({*range(1, LONG + 1), *far})

    def build(w: WindowSpec) -> list[dict[str, Column]]:
        lag_e = {f"__{n}": F.lag("__e", k).over(w) for n, k in shocks.items()}
        return [_difference(w, season), _lagged(w, steps), {"__e": F.when(F.col(_past(LONG)).isNotNull(), e)}, lag_e]

    reach = season + max(steps) + LONG + max(shocks.values())
    rows = over_rows(attach(rows, long, keys), build, before=reach, **how).where("__y IS NOT NULL")
    level = [F.col("__y"), *[F.col(_past(k)) for k in range(1, 4)]]
    found = {
        "before": level[1], "change1": level[1] - level[2], "change2": level[2] - level[3],
        "shock1": F.col("__shock1"), "shock2": F.col("__shock2"),
        "season": F.col(_past(period)) if period else F.lit(0.0),
        "season_change": F.col(_past(period)) - F.col(_past(period + 1)) if period else F.lit(0.0),
        "season_shock": F.col("__season_shock") if period else F.lit(0.0),
        "change": level[0] - level[1], "level": level[0],
    }
    whole = F.col("__shock2").isNotNull()
    if period:
        whole = whole & F.col("__season_shock").isNotNull() & F.col(_past(period + 1)).isNotNull()
    moments = rows.groupBy(*by).agg(F.count("__y").alias("points"), *_moments({t: found[t] for t in _TERMS}, whole))
    fits = moments.where(F.col("points") >= MIN_POINTS).withColumn("__best", _best(candidates))
    return fits.where("__best IS NOT NULL").select(*by, "n", "points", "__best.*"), rows


def _named(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coefficients by their usual names: of the lagged levels (or changes), shocks and seasonal ones."""

    def beta(*names: str) -> Column:
        picks = [F.get(F.col("beta"), F.array_position("idx", F.lit(_TERMS.index(n)).cast("int")).cast("int") - 1) for n in names]
        return F.coalesce(*picks, F.lit(0.0))

    level, change = F.col("d") == 0, beta("change1")
    return fits.select(
        *[c(k) for k in keys], "n", "points", "aic", "p", "d", "q", "sp", "sq", "const",
        F.when(level, F.when(F.col("p") > 0, 1 + beta("before") + change).otherwise(0.0)).otherwise(change).alias("ar1"),
        F.when(level, -change).otherwise(beta("change2")).alias("ar2"),
        beta("shock1").alias("ma1"), beta("shock2").alias("ma2"),
        beta("season", "season_change").alias("seasonal_ar"), beta("season_shock").alias("seasonal_ma"), "rss",
    )


def fit_arima(
    df: DataFrame,
    value: str,
    *,
    period: int | None = None,
    seasonal_difference: bool = False,
    candidates: Sequence[tuple[int, ...]] | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Orders, coefficients, residual sum of squares and AIC of the best model of each series.

    ``candidates`` are orders (p, d, q, P, Q), all those of the grid by default; without a ``period``
    there are no seasonal ones. All are fitted on the same rows, so their AIC values compare. Gaps are
    filled first; series under 100 points (after differencing) are left out, and so are those on which
    no order has a unique fit.
    """
    season = _season(period, seasonal_difference)
    return _named(_fitted(df, value, keys, order, period, season, candidates or orders(period), layout)[0], keys)


def _season(period: int | None, difference: bool) -> int:
    if period is not None and period < 2 or difference and period is None:
        raise ValueError("a seasonal model needs a period of at least 2")
    return period if difference else 0


def _path(ys: Column, es: Column, const: Column, steps: int, period: int | None) -> Column:
    """The recursion from the last values and innovations; later innovations are zero."""
    season = period or 1

    def back(xs: Column, k: int) -> Column:
        return F.get(xs, F.size(xs) - k)

    def step(acc: Column, _i: Column) -> Column:
        y, e = acc["y"], acc["e"]
        have = F.array(
            back(y, 1), back(y, 1) - back(y, 2), back(y, 2) - back(y, 3), back(e, 1), back(e, 2),
            back(y, season), back(y, season) - back(y, season + 1), back(e, season),
        )
        moved = const + _dot(F.col("beta"), F.transform("idx", lambda i: F.get(have, i)))
        new = F.when(F.col("target") == _CHANGE, back(y, 1) + moved).otherwise(moved)
        return F.struct(F.concat(y, F.array(new)).alias("y"), F.concat(e, F.array(F.lit(0.0))).alias("e"))

    start = F.struct(ys.alias("y"), es.alias("e"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["y"])
    return F.slice(done, F.size(ys) + 1, F.lit(steps))


def _undone(path: Column, levels: Column, season: int) -> Column:
    """Levels from seasonal differences that follow ``levels``."""

    def step(acc: Column, y: Column) -> Column:
        return F.concat(acc, F.array(y + F.get(acc, F.size(acc) - season)))

    return F.slice(F.aggregate(path, levels, step), F.size(levels) + 1, F.size(path))


def arima_forecast(
    df: DataFrame,
    value: str,
    steps: int = DEFAULT_STEPS,
    *,
    level: float = 0.95,
    period: int | None = None,
    seasonal_difference: bool = False,
    candidates: Sequence[tuple[int, ...]] | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """(keys…, step, forecast, confidence_lower, confidence_upper) from the best model of each series."""
    check_steps(steps)
    season = _season(period, seasonal_difference)
    layout = settle(df, keys, layout)
    fits, rows = _fitted(df, value, keys, order, period, season, candidates or orders(period), layout)
    reach = max(3, (period or 0) + 1)
    ends = tail_rows(
        rows.select(*[c(n) for n in dict.fromkeys([*keys, *order, TIE, "__y", "__e", "__level"])]),
        reach, keys=keys, order=order, layout=layout,
    )
    entry = F.struct(*[c(n).alias(f"o{i}") for i, n in enumerate([*order, TIE])], "__y", "__e", "__level")
    ends = ends.groupBy(*[c(k) for k in keys]).agg(F.sort_array(F.collect_list(entry)).alias("__end"))
    ready = attach(fits, ends, keys, "inner")
    levels = F.transform("__end", lambda x: x["__level"])
    path = _path(F.transform("__end", lambda x: x["__y"]), F.transform("__end", lambda x: x["__e"]), F.col("const"), steps, period)
    # A shock of one, and what it does to the steps after it.
    quiet = F.array_repeat(F.lit(0.0), reach)
    shock = F.concat(quiet, F.array(F.lit(1.0)))
    answer = F.concat(F.array(F.lit(1.0)), _path(shock, shock, F.lit(0.0), steps, period))
    if season:
        path, answer = _undone(path, levels, season), _undone(answer, F.array_repeat(F.lit(0.0), season), season)
    sigma2 = F.col("rss") / F.col("n")
    ready = ready.withColumns({"__path": path, "__answer": F.slice(answer, 1, steps)})
    spread = F.transform(
        F.sequence(F.lit(1), F.lit(steps)), lambda h: F.sqrt(sigma2 * _dot(F.slice("__answer", 1, h), F.slice("__answer", 1, h)))
    )
    out = _by_step(ready.withColumn("__se", spread), keys, {"forecast": F.col("__path"), "__se": F.col("__se")})
    band = F.lit(NormalDist().inv_cdf(0.5 + level / 2)) * F.col("__se")
    return out.withColumns({"confidence_lower": F.col("forecast") - band, "confidence_upper": F.col("forecast") + band}).drop("__se")
