"""Column names that may hold dots, and small helpers to pick columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """The name in backticks, so that ``PM2.5`` is one column and not a field access."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names that the frame has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def attach(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``names`` where NULL equals NULL; the right copies are dropped.

    Without names the right side must be one row at most; it comes in as a scalar, not as a join.
    """
    if not names:
        row = right.select(F.struct(*[c(n) for n in right.columns]).alias("__row")).scalar()
        out = left if how == "left" else left.where(row.isNotNull())
        return out.withColumns({n: row.getField(n) for n in right.columns})
    renamed = right.withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(names)})
    cond = F.lit(True)
    for i, n in enumerate(names):
        cond = cond & c(n).eqNullSafe(F.col(f"__r{i}"))
    return left.join(renamed, cond, how).drop(*[f"__r{i}" for i in range(len(names))])


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours as a double, for both timestamp types and free of the session time zone."""
    seconds = (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(3600.0)


def ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def hour_start(col: Column) -> Column:
    """Start of the hour without passing through a zoned timestamp."""
    return F.make_timestamp_ntz(
        F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.lit(0), F.lit(0)
    )


def day_start(col: Column) -> Column:
    return ntz(F.to_date(col))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def hashable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be hashed and grouped; equal values stay equal.

    Maps become their sorted entries, -0.0 becomes 0.0.
    """
    return _plain(c(name), df.schema[name].dataType)


def _plain(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(col == 0, F.lit(0).cast(kind)).otherwise(col)
    if not _has_map(kind):
        return col
    if isinstance(kind, T.MapType):
        entry = T.StructType().add("key", kind.keyType).add("value", kind.valueType)
        entries = F.transform(F.map_entries(col), lambda x: _plain(x, entry))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _plain(x, kind.elementType))
    fields = F.struct(*[_plain(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
    return F.when(col.isNotNull(), fields)
