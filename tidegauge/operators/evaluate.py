"""Forecast metrics, residuals, backtests, model choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c
from ..functions.stats import adjusted_kurtosis, adjusted_skew, pearson
from ..session import cut
from .forecast import Method, check_steps, tails
from .order import AUTO, Layout, number_rows, over_rows, settle
from .quantiles import median, quantiles

# Metrics where larger is better, the full metric list.
HIGHER_IS_BETTER = {"r2", "directional_accuracy"}
METRICS = [
    "mae", "mse", "rmse", "r2", "mape", "max_error", "median_absolute_error",
    "directional_accuracy", "normalized_rmse", "normalized_mae",
]
STATISTICS = [
    "y_true_mean", "y_true_std", "y_pred_mean", "y_pred_std", "residual_mean", "residual_std",
]


def paired(
    actual: DataFrame, predicted: DataFrame, on: Sequence[str], *, strict: bool = True
) -> DataFrame:
    """Join actual and predicted values; ``strict`` refuses frames of different length."""
    if strict and (n := actual.count()) != (m := predicted.count()):
        raise ValueError(f"length mismatch: {n} actual rows, {m} predicted")
    return attach(actual, predicted, on, "inner")


def _core(y: Column, p: Column) -> dict[str, Column]:
    """Metrics that are plain aggregates. MAPE skips zero actuals."""
    e = y - p
    n = F.count(e)
    sse = F.sum(e * e)
    total = n * F.var_pop(y)
    rmse, mae = F.sqrt(F.avg(e * e)), F.avg(F.abs(e))
    span = F.max(y) - F.min(y)
    span = F.when(span > 0, span)
    r2 = F.when(total > 0, 1 - F.try_divide(sse, total)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "n_samples": n,
        "mae": mae,
        "mse": F.avg(e * e),
        "rmse": rmse,
        "r2": F.when(n >= 2, r2),
        "mape": F.avg(F.when(y != 0, F.abs(F.try_divide(e, y)))) * 100,
        "max_error": F.max(F.abs(e)),
        "normalized_rmse": F.try_divide(rmse, span),
        "normalized_mae": F.try_divide(mae, span),
        "y_true_mean": F.avg(y),
        "y_true_std": F.stddev_pop(y),
        "y_pred_mean": F.avg(p),
        "y_pred_std": F.stddev_pop(p),
        "residual_mean": F.avg(e),
        "residual_std": F.stddev_pop(e),
    }


def metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    *,
    by: Sequence[str] = (),
    order: Sequence[str],
    rows: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """All forecast metrics per group.

    ``rows`` names the series inside a group when it mixes several; the direction of change is
    then taken within each.
    """
    y, p = c(actual), c(predicted)
    narrow = df.where(y.isNotNull() & p.isNotNull()).select(
        *[c(n) for n in dict.fromkeys([*by, *rows, *order, actual, predicted])]
    )
    layout = settle(narrow, by, layout)

    def moves(w) -> dict[str, Column]:
        dy, dp = (F.signum(x - F.lag(x, 1).over(w)) for x in (y, p))
        return {"__same": (dy == dp).cast("double")}

    stepped = over_rows(
        narrow, moves, keys=[*by, *rows], order=order, before=1, layout=layout
    )
    aggs = {**_core(y, p), "directional_accuracy": F.avg("__same") * 100}
    small = layout.how == "grouped"
    if small:
        aggs["median_absolute_error"] = median(F.abs(y - p))
    out = stepped.groupBy(*[c(k) for k in by]).agg(*[e.alias(n) for n, e in aggs.items()])
    out = out.where(F.col("n_samples") > 0)
    if not small:
        errors = narrow.select(*[c(k) for k in by], F.abs(y - p).alias("__abs"))
        middle = quantiles(errors, ["__abs"], [0.5], by=by, layout=layout)
        out = attach(
            out, middle.select(*[c(k) for k in by], F.col("quantile").alias("median_absolute_error")), by
        )
    return out.select(*[c(k) for k in by], "n_samples", *METRICS, *STATISTICS)


def to_history(scores: DataFrame, model: str, target: str, stamp: Column) -> DataFrame:
    """Scores as evaluation records: maps of metrics and of statistics."""

    def as_map(names: Sequence[str]) -> Column:
        return F.create_map(*[x for n in names for x in (F.lit(n), c(n))])

    return scores.select(
        c(model).alias("model_name"),
        c(target).alias("target"),
        stamp.cast("timestamp_ntz").alias("timestamp"),
        F.col("n_samples").cast("bigint").alias("n_samples"),
        as_map(METRICS).alias("metrics"),
        as_map(STATISTICS).alias("statistics"),
    )


def _metric_of(df: DataFrame, metric: str) -> Column:
    return c(metric) if metric in df.columns else F.col("metrics")[metric]


def _better_first(metric: str, col: Column) -> Column:
    return col.desc_nulls_last() if metric in HIGHER_IS_BETTER else col.asc_nulls_last()


def rank_models(scores: DataFrame, metric: str = "rmse", *, by: Sequence[str] = ()) -> DataFrame:
    """Add the rank by a metric, best first, missing values last.

    Without ``by`` no task sees all scores: rows are numbered in slices, and equal scores take the first
    number among them. The scores are written once, as a mean that is summed again in another order may
    differ in its last digit and would then not find its rank.
    """
    value = _metric_of(scores, metric)
    if by:
        w = Window.partitionBy(*[c(k) for k in by]).orderBy(_better_first(metric, value))
        return scores.withColumn("rank", F.rank().over(w))
    placed = scores.withColumns({"__gone": value.isNull(), "__at": -value if metric in HIGHER_IS_BETTER else value})
    placed = number_rows(cut(placed, "scores"), "__rn", order=["__gone", "__at"])
    first = placed.groupBy("__at").agg(F.min("__rn").cast("int").alias("rank"))
    return attach(placed, first, ["__at"]).drop("__gone", "__at", "__rn")


def best_model(
    scores: DataFrame,
    metric: str = "rmse",
    *,
    target: str | None = None,
    per_target: bool = False,
    model: str = "model_name",
) -> DataFrame:
    """The best row by a metric: overall, for one target, or for every target."""
    value = _metric_of(scores, metric)
    if target is not None:
        scores = scores.where(F.col("target") == target)
    # Ties go to the first name.
    key = F.when(value.isNotNull(), F.struct(-value if metric in HIGHER_IS_BETTER else value, c(model)))
    best = scores.groupBy(*(["target"] if per_target else [])).agg(
        F.min_by(F.struct(*[c(n) for n in scores.columns]), key).alias("__row")
    )
    return best.where(F.col("__row").isNotNull()).select("__row.*")


def residual_analysis(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    *,
    by: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Distribution and lag-1 autocorrelation of the residuals, with flags."""
    rows = df.select(
        *[c(n) for n in dict.fromkeys([*by, *order])], (c(actual) - c(predicted)).alias("__e")
    ).where(F.col("__e").isNotNull())
    layout = settle(rows, by, layout)
    e, before = F.col("__e"), F.col("__before")
    stepped = over_rows(
        rows, lambda w: {"__before": F.lag(e, 1).over(w)}, keys=by, order=order, before=1, layout=layout
    )
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    small = layout.how == "grouped"
    out = stepped.groupBy(*[c(k) for k in by]).agg(
        *[F.percentile(e, p).alias(n) for n, p in names.items() if small],
        F.count(e).alias("n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        adjusted_skew(e).alias("skewness"),
        adjusted_kurtosis(e).alias("kurtosis"),
        pearson(e, before).alias("autocorrelation_lag1"),
    )
    out = out.where(F.col("n") > 0)
    if not small:
        qs = quantiles(rows, ["__e"], list(names.values()), by=by, layout=layout)
        wide = qs.groupBy(*[c(k) for k in by]).agg(
            *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in names.items()]
        )
        out = attach(out, wide, by)
    return out.withColumns(
        {
            "is_centered": F.abs("mean") < 0.1 * F.col("std"),
            "is_symmetric": F.abs("skewness") < 0.5,
            "has_autocorrelation": F.abs("autocorrelation_lag1") > 0.3,
        }
    )


def _check_folds(n_splits: int, test_size: int) -> None:
    if n_splits < 1 or test_size < 1:
        raise ValueError("n_splits and test_size must be positive")
    check_steps(test_size)


def backtest_forecasts(
    df: DataFrame,
    value: str,
    method: Method,
    *,
    n_splits: int = 5,
    test_size: int = 24,
    min_train: int = 100,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """Forecasts of rolling-origin folds: (keys…, fold, step, actual, predicted).

    A tail method sees the end of each training part only, so one tail per key that covers all
    folds is enough and nothing is copied per fold.
    """
    _check_folds(n_splits, test_size)
    held = n_splits * test_size
    got = tails(
        df, value, held + max(min_train, method.reach), keys=keys, order=order, layout=layout, alphas=method.alphas
    )
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    folds = got.where(F.size("tail") >= held + min_train).select(
        *[c(k) for k in keys], "tail", F.col(method.source).alias("__source"), fold
    )
    end = F.size("tail") - (F.lit(n_splits) - F.col("fold")) * test_size
    train = folds.withColumns(
        {"__train": F.slice("__source", F.lit(1), end), "__test": F.slice("tail", end + 1, F.lit(test_size))}
    )
    paths = train.withColumn("__path", method.path(F.col("__train"), test_size))
    pairs = F.posexplode(F.arrays_zip(F.col("__test").alias("a"), F.col("__path").alias("p")))
    return paths.select(*[c(k) for k in keys], "fold", pairs.alias("__i", "__e")).select(
        *[c(k) for k in keys],
        (F.col("fold") + 1).alias("fold"),
        (F.col("__i") + 1).alias("step"),
        F.col("__e.a").alias("actual"),
        F.col("__e.p").alias("predicted"),
    )


Forecaster = Callable[..., DataFrame]


def backtest_with(
    df: DataFrame,
    value: str,
    forecaster: Forecaster,
    *,
    n_splits: int = 5,
    test_size: int = 24,
    min_train: int = 100,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """The same for any ``forecaster(df, value, steps, keys=…, order=…, layout=…)``.

    The folds become an extra key of one frame, so all of them are fitted in one job. Each row is
    copied to the folds that train on it.
    """
    _check_folds(n_splits, test_size)
    held = n_splits * test_size
    by = [c(k) for k in keys]
    rows = df.where(c(value).isNotNull()).select(*[c(n) for n in dict.fromkeys([*keys, *order, value])])
    layout = settle(rows, keys, layout)
    placed = number_rows(rows, "__back", keys=keys, order=order, descending=True, layout=layout)
    after = F.lit(held + 1) - F.col("__back")
    # Row is in the test part of fold ceil(after / test_size); the folds behind train on it.
    block = F.greatest(F.ceil(after / test_size), F.lit(0)).cast("int")
    first = block + 1
    folds = F.when(first <= n_splits, F.sequence(first, F.lit(n_splits)))
    train = placed.select(
        *[c(n) for n in dict.fromkeys([*keys, *order, value])], F.explode(folds).alias("fold")
    )
    test = placed.where(after > 0).select(
        *by,
        block.alias("fold"),
        ((after - 1) % test_size + 1).cast("int").alias("step"),
        c(value).alias("actual"),
    )
    # A fold trains on part of its series, so the layout that fits the series fits the fold.
    ahead = forecaster(train, value, test_size, keys=[*keys, "fold"], order=order, layout=layout)
    ahead = ahead.select(*by, "fold", "step", F.col("forecast").alias("predicted"))
    # Series that are too short are left out here, where there are few rows per key.
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    enough = sizes.where(F.col("__n") >= held + min_train)
    ahead = attach(ahead, enough, keys, "inner").drop("__n")
    return attach(test, ahead, [*keys, "fold", "step"], "inner").select(
        *by, "fold", "step", "actual", "predicted"
    )


def fold_scores(folds: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R² and MAPE of every fold."""
    core = _core(F.col("actual"), F.col("predicted"))
    return folds.groupBy(*[c(k) for k in keys], "fold").agg(
        *[core[m].alias(m) for m in ("mae", "rmse", "r2", "mape")]
    )


def backtest_summary(scores: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.groupBy(*[c(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_splits"),
        *[
            e.alias(f"{m}_{n}")
            for m in ("mae", "rmse", "r2", "mape")
            for n, e in (("mean", F.avg(m)), ("std", F.stddev_pop(m)))
        ],
    )
