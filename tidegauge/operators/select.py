"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import c, ntz, present
from ..sources.readings import TIME_FORMAT, parsed_time
from .order import AUTO, Layout, tail_rows, tie_of

# Allowed number of rows in one request, and the default.
MAX_ROWS, DEFAULT_ROWS = 10_000, 1_000


def parse_ts(df: DataFrame, ts: str = "datetime", fmt: str = TIME_FORMAT) -> DataFrame:
    """Parse the time column and drop the rows that do not parse."""
    return df.withColumn(ts, parsed_time(c(ts), fmt)).where(c(ts).isNotNull())


def _moment(value: str | date) -> datetime:
    return datetime.fromisoformat(str(value)).replace(tzinfo=None)


def between_ts(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= ts <= end; both ends optional."""
    if start is not None and end is not None and _moment(end) <= _moment(start):
        raise ValueError("end must be after start")
    if start is not None:
        df = df.where(c(ts) >= ntz(F.lit(start)))
    if end is not None:
        df = df.where(c(ts) <= ntz(F.lit(end)))
    return df


def pick(df: DataFrame, columns: Sequence[str], ts: str = "datetime") -> DataFrame:
    """The time column and the known ones of ``columns``; everything if none is known."""
    known = [n for n in present(df, columns) if n != ts]
    if not known:
        return df
    return df.select(*[c(n) for n in [*present(df, [ts]), *known]])


def last_n(
    df: DataFrame,
    n: int = DEFAULT_ROWS,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """The last ``n`` rows of each key in time order."""
    if not 1 <= n <= MAX_ROWS:
        raise ValueError(f"n must be between 1 and {MAX_ROWS}")
    tail = tail_rows(df, n, keys=keys, order=order, layout=layout)
    return tail.orderBy(*[c(o) for o in [*keys, *order]])


def head(df: DataFrame, n: int, by: Sequence = ()) -> DataFrame:
    """A preview of ``n`` rows, the first by ``by`` when given."""
    return (df.orderBy(*by) if by else df).limit(n)


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; text that is no number becomes NULL, and so does NaN."""

    def number(name: str):
        x = c(name).try_cast("double")
        return F.when(~F.isnan(x), x)

    return df.withColumns({n: number(n) for n in present(df, columns)})


def final_columns(df: DataFrame, values: Sequence[str], ts: str, extra: Sequence[str]) -> DataFrame:
    """Column list of the processed table: time, values, then the extra ones."""
    return df.select(*[c(n) for n in [ts, *values, *extra]])


def latest_row(df: DataFrame, *, keys: Sequence[str] = (), order: Sequence[str]) -> DataFrame:
    """The newest row of each key, as one mergeable aggregate; a hash of the row decides among equals."""
    key = F.struct(*[c(o) for o in order], tie_of(df, [*keys, *order]))
    whole = F.struct(*[c(n) for n in df.columns])
    best = df.groupBy(*[c(k) for k in keys]).agg(
        F.max_by(whole, key).alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    return best.where(F.col("__n") > 0).select(F.col("__row.*"))
