"""Autoregressive forecasts, the order chosen per series by AIC.

Fitting needs only means, variances and covariances of a value and its three lags, which are
ordinary aggregates with map-side combination; the small normal equations are solved in columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c
from .evaluate import _check_folds
from .forecast import DEFAULT_STEPS, _by_step, check_steps
from .order import AUTO, TIE, Layout, fill_gaps, number_rows, settle, with_places, with_ties
from .windows import lags

# Grid of orders, least number of points.
ORDERS = [(p, d) for p in (0, 1, 2) for d in (0, 1)]
MIN_POINTS = 100
_LAGS = 3
#: Terms of the moments, and the pairs whose covariance the fits need.
_TERMS = ["x", "u", "z0", "z1", "z2"]
_PAIRS = ["x x", "u u", "u z0", "u z1", "z0 z0", "z0 z1", "z0 z2", "z1 z1", "z1 z2", "z2 z2"]


def _lagged(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], layout: Layout) -> DataFrame:
    rows = with_ties(df, keys, order).select(*[c(n) for n in dict.fromkeys([*keys, *order, value, TIE])])
    rows = with_places(rows, keys, order, layout)
    rows = fill_gaps(rows, [value], keys=keys, order=order, how="both", layout=layout)
    return _with_lags(rows.where(c(value).isNotNull()), value, keys, order, layout)


def _with_lags(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], layout: Layout) -> DataFrame:
    return lags(
        rows, [value], range(1, _LAGS + 1), keys=keys, order=order,
        name=lambda v, k: f"__l{k}", layout=layout,
    )


def _moments(value: str) -> dict[str, Column]:
    """Means and covariances behind all fits, over the rows that have every lag.

    They are taken of the level before (``u``) and of the last three changes (``z0`` to ``z2``)
    and not of the lagged levels: these are almost equal in a wandering series, and the fit would
    drown in rounding.
    """
    x = [c(value), *[F.col(f"__l{k}") for k in range(1, _LAGS + 1)]]
    whole = x[_LAGS].isNotNull()
    terms = {"x": x[0], "u": x[1], **{f"z{i}": x[i] - x[i + 1] for i in range(3)}}
    terms = {n: F.when(whole, e) for n, e in terms.items()}
    out = {"points": F.count(x[0]), "n": F.count_if(whole)}
    out |= {f"mean {n}": F.avg(e) for n, e in terms.items()}
    for pair in _PAIRS:
        left, right = pair.split()
        out[pair] = F.covar_pop(terms[left], terms[right])
    return out


def _solve(*regressors: str) -> tuple[Column, ...]:
    """Coefficients of the last change on one or two regressors; NULL unless they are unique."""

    def s(a: str, b: str) -> Column:
        return c(" ".join(sorted((a, b))))

    if len(regressors) == 1:
        (a,) = regressors
        return (F.when(s(a, a) > 0, F.try_divide(s(a, "z0"), s(a, a))),)
    a, b = regressors
    det = s(a, a) * s(b, b) - s(a, b) * s(a, b)
    unique = det > F.lit(1e-12) * s(a, a) * s(b, b)
    return (
        F.when(unique, F.try_divide(s(a, "z0") * s(b, b) - s(b, "z0") * s(a, b), det)),
        F.when(unique, F.try_divide(s(b, "z0") * s(a, a) - s(a, "z0") * s(a, b), det)),
    )


def _candidates() -> Column:
    """One struct (aic, p, d, const, b1, b2, rss) per order; orders without a unique fit are null."""
    n = F.col("n").cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    out = []
    for p, d in ORDERS:
        # A level model of order p is the change on the level before and on p - 1 changes before.
        regressors = [[], ["u"], ["u", "z1"]][p] if d == 0 else [[], ["z1"], ["z1", "z2"]][p]
        fitted = dict(zip(regressors, _solve(*regressors), strict=True)) if regressors else {}
        variance, const = c("z0 z0"), c("mean z0")
        for name, beta in fitted.items():
            variance = variance - beta * c(" ".join(sorted((name, "z0"))))
            const = const - beta * c(f"mean {name}")
        if d == 1:
            b1, b2 = fitted.get("z1", zero), fitted.get("z2", zero)
        elif p == 0:
            variance, const, b1, b2 = c("x x"), c("mean x"), zero, zero
        else:
            change = fitted.get("z1", zero)
            b1, b2 = one + fitted["u"] + change, -change
        variance = F.greatest(variance, zero)
        # A perfect fit would have no logarithm: stop at the rounding noise of the level.
        floor = F.lit(1e-14) * c("x x") + F.lit(1e-300)
        aic = n * F.ln(F.greatest(variance, floor)) + 2 * (p + 1)
        fit = F.struct(
            aic.alias("aic"),
            F.lit(p).alias("p"),
            F.lit(d).alias("d"),
            const.alias("const"),
            b1.alias("b1"),
            b2.alias("b2"),
            (n * variance).alias("rss"),
        )
        out.append(F.when(b1.isNotNull() & b2.isNotNull() & aic.isNotNull(), fit))
    return F.array_compact(F.array(*out))


def _fitted(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], layout: Layout
) -> DataFrame:
    """The best fit and the last three values of every series, from one aggregate."""
    layout = settle(df, keys, layout)
    rows = _lagged(df, value, keys, order, layout)
    ends = F.array(*[F.col(f"__l{k}").cast("double") for k in (2, 1)], c(value).cast("double"))
    moments = rows.groupBy(*[c(k) for k in keys]).agg(
        *[e.alias(n) for n, e in _moments(value).items()],
        F.max_by(ends, F.struct(*[c(o) for o in [*order, TIE]])).alias("__tail"),
    )
    return _chosen(moments, keys)


def _chosen(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fit of least AIC from the moments of every series."""
    return (
        moments.where(F.col("points") >= MIN_POINTS)
        .withColumn("__best", F.array_min(_candidates()))
        .select(*[c(k) for k in keys], "n", "points", F.col("__best.*"), "__tail")
    )


def fit_autoregression(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Chosen order, coefficients, residual sum of squares and AIC per series.

    Gaps are filled first. All orders are fitted on the same rows (those with three earlier ones),
    so their AIC values compare. Series under 100 points are left out.
    """
    return _fitted(df, value, keys, order, layout).drop("__tail")


def _path(tail: Column, steps: int) -> Column:
    """Recursion from the last three values of a series; the fit is in the row's columns."""
    x3, x2, x1 = (F.get(tail, F.lit(i)) for i in range(3))
    diff = F.col("d") == 1
    start = F.struct(
        F.when(diff, x1 - x2).otherwise(x1).alias("s1"),
        F.when(diff, x2 - x3).otherwise(x2).alias("s2"),
        x1.alias("level"),
        F.array().cast("array<double>").alias("out"),
    )
    const, b1, b2 = F.col("const"), F.col("b1"), F.col("b2")

    def step(acc: Column, _i: Column) -> Column:
        new = const + b1 * acc["s1"] + b2 * acc["s2"]
        level = F.when(diff, acc["level"] + new).otherwise(new)
        return F.struct(
            new.alias("s1"),
            acc["s1"].alias("s2"),
            level.alias("level"),
            F.concat(acc["out"], F.array(level)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["out"])


def _spread(steps: int) -> Column:
    """Standard error per step from the weights of past shocks."""
    diff = F.col("d") == 1
    sigma2 = F.try_divide(F.col("rss"), F.col("n"))
    start = F.struct(
        F.lit(1.0).alias("w1"),
        F.lit(0.0).alias("w2"),
        F.lit(1.0).alias("sum"),
        F.lit(0.0).alias("var"),
        F.array().cast("array<double>").alias("out"),
    )

    def step(acc: Column, _i: Column) -> Column:
        weight = F.when(diff, acc["sum"]).otherwise(acc["w1"])
        var = acc["var"] + weight * weight
        following = F.col("b1") * acc["w1"] + F.col("b2") * acc["w2"]
        return F.struct(
            following.alias("w1"),
            acc["w1"].alias("w2"),
            (acc["sum"] + following).alias("sum"),
            var.alias("var"),
            F.concat(acc["out"], F.array(F.sqrt(var * sigma2))).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["out"])


def autoregressive_forecast(
    df: DataFrame,
    value: str,
    steps: int = DEFAULT_STEPS,
    *,
    level: float = 0.95,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """(keys…, step, forecast, confidence_lower, confidence_upper) from the best order."""
    check_steps(steps)
    fits = _fitted(df, value, keys, order, layout)
    ready = fits.withColumns({"__path": _path(F.col("__tail"), steps), "__se": _spread(steps)})
    out = _by_step(ready, keys, {"forecast": F.col("__path"), "__se": F.col("__se")})
    band = F.lit(NormalDist().inv_cdf(0.5 + level / 2)) * F.col("__se")
    return out.withColumns(
        {"confidence_lower": F.col("forecast") - band, "confidence_upper": F.col("forecast") + band}
    ).drop("__se")


def _merged(blocks: DataFrame, keys: Sequence[str], n_splits: int) -> DataFrame:
    """Moments of the rows that each fold trains on, from those of the blocks before it.

    The covariances are put together around the common mean, so nothing cancels.
    """
    folds = blocks.withColumn("fold", F.explode(F.sequence(F.col("block") + 1, F.lit(n_splits))))
    by = [*[c(k) for k in keys], F.col("fold")]
    w = Window.partitionBy(*by)

    def pooled(x: Column) -> Column:
        return F.try_divide(F.sum(F.col("n") * x), F.sum("n"))

    whole = F.sum("n").over(w)
    common = {f"all {t}": F.try_divide(F.sum(F.col("n") * c(f"mean {t}")).over(w), whole) for t in _TERMS}
    out = [F.sum("points").alias("points"), F.sum("n").alias("n"), *[pooled(c(f"mean {t}")).alias(f"mean {t}") for t in _TERMS]]
    for pair in _PAIRS:
        left, right = (c(f"mean {t}") - c(f"all {t}") for t in pair.split())
        out.append(pooled(c(pair) + left * right).alias(pair))
    last = F.col("block") == F.col("fold") - 1
    ends = [F.max(F.when(last, F.col(f"__t{i}"))) for i in range(_LAGS)]
    return folds.withColumns(common).groupBy(*by).agg(*out, F.array(*ends).alias("__tail"))


def backtest_autoregression(
    df: DataFrame,
    value: str,
    *,
    n_splits: int = 5,
    test_size: int = 24,
    min_train: int = 100,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """``backtest_with`` these forecasts, without a copy of the rows per fold.

    Folds train on growing parts of one series. So the series is laid out and lagged once, each part that
    a fold adds gives its moments, and a fold is fitted from those of the parts before it.
    """
    _check_folds(n_splits, test_size)
    held = n_splits * test_size
    rows = df.where(c(value).isNotNull()).select(*[c(n) for n in dict.fromkeys([*keys, *order, value])])
    layout = settle(rows, keys, layout)
    how = {"keys": keys, "order": order, "layout": layout}
    rows = number_rows(with_places(rows, keys, order, layout), "__back", descending=True, **how)
    after = F.lit(held + 1) - F.col("__back")
    # The block of a row is the fold that tests on it; 0 is what all folds train on.
    rows = rows.withColumn("block", F.greatest(F.ceil(after / test_size), F.lit(0)).cast("int"))
    test = rows.where(F.col("block") > 0).select(
        *[c(k) for k in keys],
        F.col("block").alias("fold"),
        ((after - 1) % test_size + 1).cast("int").alias("step"),
        c(value).alias("actual"),
    )
    last = after == F.col("block") * test_size
    ends = [F.col("__l2"), F.col("__l1"), c(value)]
    blocks = (
        _with_lags(rows, value, keys, order, layout)
        .where(F.col("block") < n_splits)
        .groupBy(*[c(k) for k in keys], "block")
        .agg(
            *[e.alias(n) for n, e in _moments(value).items()],
            *[F.max(F.when(last, x.cast("double"))).alias(f"__t{i}") for i, x in enumerate(ends)],
        )
    )
    # Series that are too short for all folds are left out.
    least = F.lit(min_train) + (F.col("fold") - 1) * test_size
    fits = _chosen(_merged(blocks, keys, n_splits).where(F.col("points") >= least), [*keys, "fold"])
    paths = fits.withColumn("__path", _path(F.col("__tail"), test_size))
    ahead = _by_step(paths, [*keys, "fold"], {"predicted": F.col("__path")})
    return attach(test, ahead, [*keys, "fold", "step"], "inner").select(
        *[c(k) for k in keys], "fold", "step", "actual", "predicted"
    )
