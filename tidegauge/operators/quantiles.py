"""Exact interpolated quantiles whose work stays spread out at any size.

A small group is sorted in one array, which its ranks are taken from. For a larger group the wanted order statistics are bracketed instead: an
approximate quantile grid (a small mergeable sketch) narrows the interval that holds the wanted
rank by a factor of about 100 per pass, exact counts confirm it, and only the last small interval
is ordered. Where there are very many groups, sketches of all would be more than the values: there the
distinct values are counted and sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c, hashable
from ..session import cut
from .order import _POS, _SLICE, AUTO, Layout, _numbered, settle

_GRID = 128
_ACCURACY = 20_000
#: Open ranks (a group's name and a few numbers each) that are sent to every executor; more are shuffled.
_BROADCAST_RANKS = 100_000
#: Open ranks that are searched by sketches, one for each; with more the values are sorted instead.
_SEARCHED_RANKS = 1_000


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def _halves(x: Column) -> tuple[Column, Column]:
    """Two parts of a double with half its digits each, so that products of parts are exact."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def between(low: Column, high: Column, part: Column) -> Column:
    """``low * (1 - part) + high * part`` with the second product rounded, then the sum rounded once.

    That is a fused multiply-add, as SQL engines interpolate: a bound of an outlier filter often is a value of
    the data, and a last digit more or less then decides about rows.
    """
    rest = 1 - part
    left, right = low * rest, high * part
    (a, b), (x, y) = _halves(low), _halves(rest)
    lost = ((a * x - left) + a * y + b * x) + b * y
    total = left + right
    back = total - left
    once = total + (((left - (total - back)) + (right - back)) + lost)
    fused = F.when(F.abs(once) < F.lit(float("inf")), once).otherwise(total)
    return F.when(part == 0, low).otherwise(fused)


def _place(n: Column, prob: Column) -> tuple[Column, Column, Column]:
    """The rank at or below the wanted place among ``n`` values, the rank after it, and the part beyond it."""
    place = prob * (n - 1)
    rank = F.floor(place).cast("long")
    return rank, F.least(rank + 1, n - 1), place - rank


def _picked(x: Column, prob: float) -> Column:
    """The quantile of a sorted array."""
    rank, following, part = _place(F.size(x), F.lit(float(prob)))
    return between(F.get(x, rank.cast("int")), F.get(x, following.cast("int")), part)


def quantiles(
    df: DataFrame,
    values: Sequence[str],
    probs: Sequence[float],
    *,
    by: Sequence[str] = (),
    approx: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """Long table (by…, variable, prob, quantile); columns without values give NULL."""
    group = [c(b) for b in by]
    if not approx:
        layout = settle(df, by, layout)
    if approx or layout.how == "grouped":
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        cells = {f"__q{i}": c(v).cast("double") for i, v in enumerate(values)}
        if approx:
            wide = df.groupBy(*group).agg(*[F.percentile_approx(x, wanted).alias(q) for q, x in cells.items()])
        else:
            wide = df.groupBy(*group).agg(*[F.sort_array(F.collect_list(x)).alias(q) for q, x in cells.items()])
            wide = wide.withColumns({q: F.array(*[_picked(F.col(q), p) for p in probs]) for q in cells})
        rows = F.array(
            *[
                F.struct(
                    F.lit(v).alias("variable"),
                    F.lit(float(p)).alias("prob"),
                    F.get(F.col(f"__q{i}"), F.lit(j)).alias("quantile"),
                )
                for i, v in enumerate(values)
                for j, p in enumerate(probs)
            ]
        )
        return wide.select(*group, F.inline(rows))
    if by and _groups(df, by) * len(values) * 2 * len(probs) > _SEARCHED_RANKS:
        return _sorted(df, values, probs, by, layout)
    return _bracketed(df, values, probs, by, layout.limit)


def _groups(df: DataFrame, by: Sequence[str]) -> int:
    """About how many groups there are: one scan of their columns, one small sketch."""
    name = F.struct(*[hashable(df, b) for b in by])
    return df.agg(F.approx_count_distinct(F.xxhash64(name))).first()[0]


def _long(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by…, variable, __x) of all values that are there."""
    cells = [F.struct(F.lit(v).alias("variable"), c(v).cast("double").alias("__x")) for v in values]
    return df.select(*[c(b) for b in by], F.inline(F.array(*cells))).where(F.col("__x").isNotNull())


def _sorted(
    df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str], layout: Layout
) -> DataFrame:
    """Quantiles of very many groups, with as much work as a sort whatever their number.

    The values of all groups are counted, the counts sorted by group and value over all tasks and cut into
    slices; a running sum over the slices of a group tells which of them hold its ranks.
    """
    group = [*by, "variable"]
    names = [c(g) for g in group]
    counts = cut(_long(df, values, by).groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__n")), "counts")
    sized = cut(counts.groupBy(*names).agg(F.sum("__n").alias("__n")), "sizes")
    rows = _numbered(counts, group, ["__x"], layout.slice_rows, (layout.total or 0) * len(values)).drop(_POS)
    upto = Window.partitionBy(*names).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, 0)
    slices = rows.groupBy(*names, _SLICE).agg(F.sum("__n").alias("__in"))
    slices = slices.withColumn("__below", F.sum("__in").over(upto) - F.col("__in"))
    ranks = [r for p in probs for r in _place(F.col("__n"), F.lit(float(p)))[:2]]
    wanted = sized.select(*names, F.array_distinct(F.array(*ranks)).alias("__ranks"))

    def inside(below: str, n: str) -> Column:
        return F.filter("__ranks", lambda r: (r >= F.col(below)) & (r < F.col(below) + F.col(n)))

    hits = attach(slices, wanted, group, "inner").withColumn("__ranks", inside("__below", "__in"))
    hits = hits.where(F.size("__ranks") > 0).drop("__in")
    w = Window.partitionBy(F.col(_SLICE), *names).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    near = attach(rows, hits, [_SLICE, *group], "inner")
    near = near.withColumn("__below", F.col("__below") + F.sum("__n").over(w) - F.col("__n"))
    found = near.select(*names, F.explode(inside("__below", "__n")).alias("__rank"), F.col("__x").alias("__value"))
    return _interpolated(cut(found, "found"), group, sized, probs)


def _bracketed(
    df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str], limit: int
) -> DataFrame:
    spark = df.sparkSession
    long = cut(_long(df, values, by), "values")
    group = [*by, "variable"]
    sized = cut(long.groupBy(*[c(g) for g in group]).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    large = sized.where(F.col("__n") > limit)

    # Small groups take the plain way.
    small = attach(long, sized.where(F.col("__n") <= limit), group, "inner")
    picks = [F.struct(F.lit(float(p)).alias("prob"), _picked(F.col("__all"), p).alias("quantile")) for p in probs]
    plain = (
        small.groupBy(*[c(g) for g in group])
        .agg(F.sort_array(F.collect_list("__x")).alias("__all"))
        .select(*[c(g) for g in group], F.inline(F.array(*picks)))
    )
    out = plain.unionByName(_interpolated(_searched(long, group, large, probs, limit), group, large, probs))
    if by:
        return out
    every = spark.createDataFrame([(v, float(p)) for v in values for p in probs], "variable string, prob double")
    return every.join(out, ["variable", "prob"], "left").select("variable", "prob", "quantile")


def _ranks(large: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Per large group and probability the rank at or below the wanted place, and the part beyond it."""
    rows = large.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    return rows.withColumns(dict(zip(("__rank", "__next", "__part"), _place(F.col("__n"), F.col("prob")), strict=True)))


def _interpolated(found: DataFrame, group: list[str], large: DataFrame, probs: Sequence[float]) -> DataFrame:
    ranks = _ranks(large, probs)
    low = found.withColumnRenamed("__value", "__a")
    high = found.select(*[c(g) for g in group], F.col("__rank").alias("__next"), F.col("__value").alias("__b"))
    both = attach(attach(ranks, low, [*group, "__rank"], "inner"), high, [*group, "__next"], "inner")
    value = between(F.col("__a"), F.col("__b"), F.col("__part"))
    return both.select(*[c(g) for g in group], "prob", value.alias("quantile"))


def _spanned(long: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """Every value with the open ranks of its group."""
    return attach(long, F.broadcast(spans) if spans.count() <= _BROADCAST_RANKS else spans, group, "inner")


def _searched(long: DataFrame, group: list[str], large: DataFrame, probs: Sequence[float], limit: int) -> DataFrame:
    """(group, __rank, __value) of the large groups, by narrowing one interval per group and rank.

    All groups take part in every pass and the open intervals stay in tables, so the number of passes
    depends on the size of the largest group alone, and only counts come to the driver.
    """
    by = [c(g) for g in group]
    both = _ranks(large, probs).select(*by, F.explode(F.array("__rank", "__next")).alias("__rank")).distinct()
    ends = {"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))}
    spans = cut(both.withColumns(ends), "spans")
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    inside = F.when(F.col("__x").between(F.col("__lo"), F.col("__hi")), F.col("__x"))
    done = []
    while spans.take(1):
        state = (
            _spanned(long, spans, group)
            .groupBy(*by, "__rank", "__lo", "__hi")
            .agg(
                F.count_if(F.col("__x") < F.col("__lo")).alias("__below"),
                F.count(inside).alias("__in"),
                F.min(inside).alias("__min"),
                F.max(inside).alias("__max"),
                F.percentile_approx(inside, grid, _ACCURACY).alias("__cuts"),
            )
        )
        at = (F.col("__rank") - F.col("__below")) / F.col("__in")
        low = F.floor((at - 4 / _ACCURACY) * _GRID).cast("int")
        high = F.floor((at + 4 / _ACCURACY) * _GRID).cast("int") + 1
        state = cut(
            state.withColumns(
                {
                    "__low": F.when(low > 0, F.get("__cuts", low)).otherwise(F.col("__min")),
                    "__high": F.when(high < _GRID, F.get("__cuts", high)).otherwise(F.col("__max")),
                }
            ).drop("__cuts"),
            "state",
        )
        single = F.col("__min") == F.col("__max")
        # A span that the grid cannot split further is mostly one heavy value.
        stuck = (F.col("__low") == F.col("__lo")) & (F.col("__high") == F.col("__hi"))
        few = (F.col("__in") <= limit) | stuck
        done.append(state.where(single).select(*by, "__rank", F.col("__min").alias("__value")))
        done.append(_resolved(long, state.where(~single & few), group))
        spans = state.where(~single & ~few).select(*by, "__rank", F.col("__low").alias("__lo"), F.col("__high").alias("__hi"))
    found = long.select(*by, F.lit(0).cast("long").alias("__rank"), F.col("__x").alias("__value")).limit(0)
    for part in done:
        found = found.unionByName(part)
    return cut(found, "found")


def _resolved(long: DataFrame, few: DataFrame, group: list[str]) -> DataFrame:
    """The wanted rank inside spans that hold few distinct values."""
    by = [c(g) for g in group]
    few = few.select(*by, "__rank", "__lo", "__hi", "__below")
    near = _spanned(long, few, group).where(F.col("__x").between(F.col("__lo"), F.col("__hi")))
    histogram = near.groupBy(*by, "__rank", "__below", "__x").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by, "__rank").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    upto = histogram.withColumn("__upto", F.col("__below") + F.sum("__n").over(w))
    hit = F.col("__rank").between(F.col("__upto") - F.col("__n"), F.col("__upto") - 1)
    return upto.where(hit).select(*by, "__rank", F.col("__x").alias("__value"))
