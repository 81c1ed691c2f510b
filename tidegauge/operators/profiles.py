"""Profiles of values over calendar buckets, trends, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c, day_start, hashable, ntz
from ..functions import calendar
from ..functions.stats import pearson, strength
from ..session import cut
from .duplicates import copy_counts
from .order import AUTO, Layout, settle, tie_of
from .quantiles import median, quantiles
from .windows import percent_change

BUCKETS = ("hour", "dayofweek", "month", "year")
_STATS = ("mean", "std", "min", "max", "count")


def bucket_of(ts: Column, bucket: str) -> Column:
    return calendar.parts(ts)[bucket]


def _stats(x: Column) -> list[Column]:
    """Mean, sample deviation, minimum, maximum and number of non-null values."""
    return [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), F.count(x)]


def _named(df: DataFrame, bucket: str, short_months: bool) -> DataFrame:
    if bucket == "dayofweek":
        return df.withColumn("day_name", calendar.day_name_of(c(bucket)))
    if bucket == "month":
        return df.withColumn("month_name", calendar.month_name_of(c(bucket), short_months))
    return df


def profile(
    df: DataFrame,
    value: str,
    bucket: str,
    ts: str = "datetime",
    *,
    keys: Sequence[str] = (),
    short_months: bool = True,
) -> DataFrame:
    """Statistics of a value per hour of day, day of week, month or year."""
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket: {bucket}")
    out = df.groupBy(*[c(k) for k in keys], bucket_of(c(ts), bucket).alias(bucket)).agg(
        *[s.alias(n) for s, n in zip(_stats(c(value)), _STATS, strict=True)]
    )
    return _named(out, bucket, short_months)


def profiles(
    df: DataFrame, values: Sequence[str], ts: str = "datetime", *, keys: Sequence[str] = ()
) -> DataFrame:
    """All four profiles of many values: (keys…, variable, bucket, bucket_value, statistics).

    One scan and one aggregation over grouping sets; the long form is made from its small result.
    """
    parts = {b: f"__{b}" for b in BUCKETS}
    base = df.select(
        *[c(k) for k in keys],
        *[bucket_of(c(ts), b).alias(n) for b, n in parts.items()],
        *[c(v).alias(f"__v{i}") for i, v in enumerate(values)],
    )
    key_cols = [c(k) for k in keys]
    # The grouping-set id, not a null bucket, tells the sets apart: a row without time has null parts.
    bits = F.grouping_id()
    wide = base.groupingSets(
        [[*key_cols, F.col(n)] for n in parts.values()], *key_cols, *[F.col(n) for n in parts.values()]
    ).agg(
        bits.alias("__set"),
        *[
            s.alias(f"__v{i}_{n}")
            for i in range(len(values))
            for s, n in zip(_stats(F.col(f"__v{i}")), _STATS, strict=True)
        ],
    )
    # Each set groups by exactly one part, so its id has every part's bit set but one.
    full = (1 << len(parts)) - 1
    which, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (b, n) in enumerate(parts.items()):
        hit = F.col("__set") == full - (1 << (len(parts) - 1 - i))
        which = F.when(hit, F.lit(b)).otherwise(which)
        number = F.when(hit, F.col(n)).otherwise(number)
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable"), *[F.col(f"__v{i}_{n}").alias(n) for n in _STATS]
            )
            for i, v in enumerate(values)
        ]
    )
    return wide.select(
        *key_cols, which.alias("bucket"), number.alias("bucket_value"), F.inline(rows)
    )


def extremes(table: DataFrame, bucket: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Peak and low bucket by mean, the peak's maximum and the low's minimum; first bucket wins ties."""
    row = F.struct(c(bucket).alias("b"), c("mean").alias("mean"), c("min").alias("min"), c("max").alias("max"))
    out = (
        table.where(F.col("mean").isNotNull() & c(bucket).isNotNull())
        .groupBy(*[c(k) for k in by])
        .agg(
            F.max_by(row, F.struct(F.col("mean"), -c(bucket))).alias("__p"),
            F.min_by(row, F.struct(F.col("mean"), c(bucket))).alias("__l"),
        )
    )
    return out.where(F.col("__p").isNotNull()).select(
        *[c(k) for k in by],
        F.col("__p.b").alias(f"peak_{bucket}"),
        F.col("__p.mean").alias("peak_mean"),
        F.col("__p.max").alias("peak_max"),
        F.col("__l.b").alias(f"low_{bucket}"),
        F.col("__l.mean").alias("low_mean"),
        F.col("__l.min").alias("low_min"),
    )


def variation(table: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Range of the bucket means and the mean coefficient of variation."""
    return table.groupBy(*[c(k) for k in by]).agg(
        (F.max("mean") - F.min("mean")).alias("range"),
        F.avg(F.try_divide(F.col("std"), F.col("mean"))).alias("coefficient_of_variation"),
    )


def weekend_split(days: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Average of the day means on weekends and on weekdays, with their difference."""
    weekend = calendar.is_weekend_day(c("dayofweek"))
    out = days.groupBy(*[c(k) for k in by]).agg(
        F.avg(F.when(weekend, F.col("mean"))).alias("weekend_average"),
        F.avg(F.when(~weekend, F.col("mean"))).alias("weekday_average"),
    )
    gap = F.col("weekend_average") - F.col("weekday_average")
    return out.withColumns(
        {
            "difference": gap,
            "percent_difference": F.try_divide(gap, F.col("weekday_average")) * 100,
        }
    )


def season_averages(months: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Average of the month means per season, one column per season."""
    season = calendar.season(c("month"))
    return months.groupBy(*[c(k) for k in by]).agg(
        *[
            F.avg(F.when(season == name, F.col("mean"))).alias(f"{name}_average")
            for name in calendar.SEASONS
        ]
    )


def season_extremes(seasons: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Names of the highest and lowest season; seasons without data are ignored."""

    def wanted(pick) -> Column:
        best = pick(*[F.col(f"{n}_average") for n in calendar.SEASONS])
        out = F.lit(None).cast("string")
        for n in reversed(list(calendar.SEASONS)):
            out = F.when(F.col(f"{n}_average") == best, F.lit(n)).otherwise(out)
        return out

    return seasons.select(
        *[c(k) for k in by],
        wanted(F.greatest).alias("highest_season"),
        wanted(F.least).alias("lowest_season"),
    )


def yearly_changes(years: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Change of the yearly mean in percent."""
    return percent_change(years, "mean", "year", keys=by, name="yoy_change")


def yearly_trend(years: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the yearly mean, its correlation and labels, and the average change."""
    x, y = F.col("year").cast("double"), F.col("mean")
    out = (
        yearly_changes(years, by=by)
        .groupBy(*[c(k) for k in by])
        .agg(
            F.count(y).alias("n_years"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            pearson(x, y).alias("correlation"),
            F.avg("yoy_change").alias("average_percent_change"),
        )
    )
    enough = F.col("n_years") >= 2
    r = F.col("correlation")
    return out.withColumns(
        {
            **{
                n: F.when(enough, F.col(n))
                for n in ("slope", "intercept", "correlation", "average_percent_change")
            },
            "trend_direction": F.when(
                enough, F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
            ),
            "trend_strength": F.when(enough, strength(r, [(0.7, "strong"), (0.3, "moderate")], "weak")),
            "status": F.when(enough, "ok").otherwise("insufficient"),
        }
    )


def monotonic_trend(years: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """``increasing``, ``decreasing`` or ``variable``, not strictly; over the short table of years."""
    w = Window.partitionBy(*[c(k) for k in by]).orderBy("year")
    stepped = years.withColumn("__b", F.lag("mean").over(w))
    up = F.coalesce(F.bool_and(F.col("mean") >= F.col("__b")), F.lit(True))
    down = F.coalesce(F.bool_and(F.col("mean") <= F.col("__b")), F.lit(True))
    label = F.when(up, "increasing").when(down, "decreasing").otherwise("variable")
    return stepped.groupBy(*[c(k) for k in by]).agg(label.alias("trend"))


def insights(
    df: DataFrame, values: Sequence[str], ts: str = "datetime", *, keys: Sequence[str] = ()
) -> DataFrame:
    """Per value: peak hour, day and month, highest and lowest season, trend."""
    by = [*keys, "variable"]
    # A few rows per key and value, read five times below.
    every = cut(profiles(df, values, ts, keys=keys), "profiles")

    def part(bucket: str) -> DataFrame:
        return every.where(F.col("bucket") == bucket).withColumnRenamed("bucket_value", bucket)

    hours, days, months, years = (part(b) for b in BUCKETS)
    out = extremes(hours, "hour", by=by).select(*[c(k) for k in by], "peak_hour")
    day = extremes(days, "dayofweek", by=by).select(
        *[c(k) for k in by], calendar.day_name_of(F.col("peak_dayofweek")).alias("peak_day")
    )
    month = extremes(months, "month", by=by).select(
        *[c(k) for k in by], calendar.month_name_of(F.col("peak_month"), True).alias("peak_month")
    )
    season = season_extremes(season_averages(months, by=by), by=by)
    trend = yearly_trend(years, by=by).select(
        *[c(k) for k in by], "trend_direction", "trend_strength", F.col("correlation").alias("trend_correlation")
    )
    for piece in (day, month, season, trend):
        out = attach(out, piece, by)
    return out


def _inline(values: Sequence[str], fields: Sequence[str]) -> Column:
    """Turn the wide result columns ``v{i}_{field}`` into one row per value."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(v).alias("variable"), *[F.col(f"v{i}_{f}").alias(f) for f in fields])
                for i, v in enumerate(values)
            ]
        )
    )


def summary(
    df: DataFrame,
    values: Sequence[str],
    ts: str = "datetime",
    *,
    latest: bool = False,
    tie: Sequence[str] = (),
    layout: Layout = AUTO,
) -> DataFrame:
    """One row per value: table rows, columns and time range, mean, std, min, max, median, nulls.

    ``latest`` adds the newest non-null value and its difference to the mean.
    """
    fields = ["mean", "std", "min", "max", "null_count"]
    when = F.struct(c(ts), *[c(t) for t in tie], tie_of(df, [ts, *tie]))
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(c(ts)).alias("start"), F.max(c(ts)).alias("end")]
    for i, v in enumerate(values):
        x = c(v)
        aggs += [
            s.alias(f"v{i}_{n}")
            for s, n in zip(
                [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), F.count_if(x.isNull())], fields, strict=True
            )
        ]
        if latest:
            aggs.append(F.max_by(x, F.when(x.isNotNull(), when)).alias(f"v{i}_latest"))
    if latest:
        fields = [*fields, "latest"]
    layout = settle(df, (), layout)
    if layout.how == "grouped":
        fields.append("median")
        aggs += [median(c(v).cast("double")).alias(f"v{i}_median") for i, v in enumerate(values)]
    wide = df.agg(*aggs)
    out = wide.select(
        "rows", F.lit(len(df.columns)).alias("columns"), "start", "end", _inline(values, fields)
    )
    if layout.how != "grouped":
        middle = quantiles(df, values, [0.5], layout=layout).select(
            "variable", F.col("quantile").alias("median")
        )
        out = out.join(middle, "variable", "left")
    if latest:
        out = out.withColumn("latest_minus_mean", F.col("latest") - F.col("mean"))
    return out


def quality_counters(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """Per column: type, nulls and distinct values; with the table's rows, columns, nulls, copies.

    Every column is scanned alone and grouped by its own type, so only its distinct values are moved
    and no task holds them all.
    """
    names = df.columns
    types = dict(df.dtypes)
    per = None
    for n in names:
        x = df.select(hashable(df, n).alias("x"))
        if approx:
            found = x.agg(
                F.count_if(F.col("x").isNull()).alias("null_count"),
                F.approx_count_distinct("x").alias("distinct_count"),
            )
        else:
            # A hot value is combined on the map side before the shuffle.
            found = x.groupBy("x").agg(F.count(F.lit(1)).alias("n")).agg(
                F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
                F.count("x").alias("distinct_count"),
            )
        found = found.select(F.lit(n).alias("column"), "null_count", "distinct_count")
        per = found if per is None else per.unionByName(found)
    typed = F.create_map(*[F.lit(s) for n in names for s in (n, types[n])])
    rows, copies = copy_counts(df)
    everything = Window.partitionBy()
    return per.select(
        "column",
        typed[F.col("column")].alias("type"),
        "null_count",
        "distinct_count",
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(len(names)).alias("columns"),
        F.lit(copies).cast("bigint").alias("duplicate_rows"),
        F.sum("null_count").over(everything).alias("total_nulls"),
    )


def daily_means(
    df: DataFrame, value: str, ts: str = "datetime", *, keys: Sequence[str] = (), name: str = "mean"
) -> DataFrame:
    """Mean per calendar day; days without rows are present with NULL."""
    by = [c(k) for k in keys]
    days = df.groupBy(*by, day_start(c(ts)).alias("day")).agg(F.avg(c(value)).alias(name))
    known = days.where(F.col("day").isNotNull())
    span = known.groupBy(*by).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    dates = F.sequence(F.to_date("__a"), F.to_date("__b"), F.expr("interval 1 day"))
    calendar_days = span.where(F.col("__a").isNotNull()).select(*by, F.explode(dates).alias("__d"))
    calendar_days = calendar_days.select(*by, ntz(F.col("__d")).alias("day"))
    return attach(calendar_days, known, [*keys, "day"])


def overall(df: DataFrame, value: str, *, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[c(k) for k in keys]).agg(
        F.avg(c(value)).alias("mean"), F.stddev_samp(c(value)).alias("std")
    )


