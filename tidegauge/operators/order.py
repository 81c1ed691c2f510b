"""Ordered work on series of any length.

A series is the rows of one key (or the whole table when there are no keys) in the order of
``order``. Spark puts each window partition into one task, which is fine while the largest series
is known to be small, and wrong for one long series or a key that holds a third of the table.
Each function here has two layouts:

* ``grouped``: an ordinary window per key. Taken when a count shows that no series has more than
  ``limit`` rows.
* ``sliced``: the rows are range-partitioned by (keys, order), so that any skew in keys or in time
  is spread evenly, written once, and numbered. Slices of ``slice_rows`` consecutive rows then
  become the window partitions. Bounded frames copy the few border rows into the neighbouring
  slice; unbounded ones carry one small row per slice across.

``order`` should identify rows (time plus an id) wherever ties would make the result ambiguous. Rows
that tie are put in the order of a hash of their other columns, in both layouts alike, so a result
does not depend on the size of the table. Steps that follow each other, on ever fewer or more columns,
take the hash once, on the whole rows they start from (``with_ties``), and carry it. They may also carry the
place of each row (``with_places``): the sliced layout then moves and writes the table once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import attach, c, hashable
from ..session import cut

#: Largest series that one task may hold.
GROUP_LIMIT = 1_000_000
#: Rows per slice in the sliced layout.
SLICE_ROWS = 250_000
#: Rows that one range partition should sort, and the most partitions one shuffle should have.
_PARTITION_ROWS, _MAX_PARTITIONS = 8_000_000, 50_000

_ID, _PART, _POS, _SLICE, _OWN, _TIE = "__id", "__part", "__pos", "__slice", "__own", "__tie"
TIE, PLACE = _TIE, _POS

Stage = dict[str, Column]


@dataclass(frozen=True)
class Layout:
    """How a series is laid out: ``auto`` checks the size, the others force one way.

    ``largest`` and ``total`` are the rows of the largest key and of the table, once counted.
    """

    how: str = "auto"
    limit: int = GROUP_LIMIT
    slice_rows: int = SLICE_ROWS
    largest: int | None = None
    total: int | None = None

    def __post_init__(self) -> None:
        if self.how not in ("auto", "grouped", "sliced"):
            raise ValueError(f"unknown layout: {self.how}")


AUTO = Layout()


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the whole table: one scan of the key columns."""
    if not keys:
        n = df.count()
        return n, n
    row = (
        df.groupBy(*[c(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("__n"))
        .agg(F.max("__n").alias("largest"), F.sum("__n").alias("total"))
        .first()
    )
    return int(row["largest"] or 0), int(row["total"] or 0)


def _sized(df: DataFrame, keys: Sequence[str], layout: Layout) -> Layout:
    """The layout with its row counts, counted unless they are known."""
    if layout.total is not None:
        return layout
    largest, total = group_sizes(df, keys)
    return replace(layout, largest=largest, total=total)


def settle(df: DataFrame, keys: Sequence[str], layout: Layout) -> Layout:
    """Decide an ``auto`` layout once, for several steps over the same (or fewer) rows."""
    if layout.how == "grouped":
        return layout
    layout = _sized(df, keys, layout)
    if layout.how == "sliced":
        return layout
    return replace(layout, how="grouped" if layout.largest <= layout.limit else "sliced")


def _choose(df: DataFrame, keys: Sequence[str], layout: Layout) -> tuple[bool, int | None]:
    """(use the grouped layout, number of rows if it is needed)."""
    settled = settle(df, keys, layout)
    return settled.how == "grouped", settled.total


def tie_of(df: DataFrame, named: Sequence[str]) -> Column:
    """The hash that orders rows which tie on the columns ``named``, or the one that they carry."""
    if _TIE in df.columns:
        return F.col(_TIE)
    rest = [hashable(df, n) for n in df.columns if n not in named]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")


def with_ties(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the hash that orders ties, for steps that all keep to one order of the rows.

    It stands in the column ``TIE``; such steps carry it on, and whoever added it drops it.
    """
    return _tied(df, keys, order)


def with_places(df: DataFrame, keys: Sequence[str], order: Sequence[str], layout: Layout) -> DataFrame:
    """The rows with the hash that orders ties and, in the sliced layout, with their places in (keys, order).

    Steps over such rows read the places and do not lay the rows out again; whoever added them drops
    ``TIE`` and ``PLACE``. Between the steps only whole series and first rows of series may be left out.
    """
    layout = settle(df, keys, layout)
    if layout.how == "grouped":
        return with_ties(df, keys, order)
    return _numbered(_tied(df, keys, order), keys, order, layout.slice_rows, layout.total).drop(_SLICE)


def _tied(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the hash that orders rows which tie on (keys, order), unless they carry one."""
    return df if _TIE in df.columns else df.withColumn(_TIE, tie_of(df, {*keys, *order}))


def _without_tie(df: DataFrame, given: DataFrame) -> DataFrame:
    """``df`` without the hash, unless the frame it was made from had come with it."""
    return df if _TIE in given.columns else df.drop(_TIE)


def _window(keys: Sequence[str], order: Sequence[str], descending: bool = False) -> WindowSpec:
    """Window over a frame that ``_tied`` made; descending is the exact reverse of ascending."""
    ordered = [c(o).desc() if descending else c(o).asc() for o in [*order, _TIE]]
    return Window.partitionBy(*[c(k) for k in keys]).orderBy(*ordered) if keys else Window.orderBy(*ordered)


def _numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_rows: int,
    total: int | None,
    descending: bool = False,
) -> DataFrame:
    """Add the position of each row in (keys, order) and the slice it belongs to.

    The range partitioner samples its bounds, so two plans could cut differently; the numbered
    rows are therefore written once and every later branch reads that copy.

    Rows that tie on (keys, order) are told apart by a hash of the rest, and full copies of a row
    by the input partition they come from. So not even a third of all rows with one stamp lands in
    one task, and a task that is run again sends every row to the same place.
    """
    spark = df.sparkSession
    # The session's number of partitions, which Spark may merge, unless the table needs more.
    needed = min(ceil((total or 0) / _PARTITION_ROWS), _MAX_PARTITIONS)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [needed] if needed > usual else []
    ties = [_TIE, "__from"]
    by = [c(n).desc() if descending else c(n).asc() for n in [*order, *ties]]
    by = [*[c(k) for k in keys], *by]
    placed = cut(
        _tied(df, keys, order)
        .withColumn("__from", F.spark_partition_id())
        .repartitionByRange(*parts, *by)
        .sortWithinPartitions(*by)
        .drop(*(t for t in ties if t not in df.columns))
        .withColumn(_ID, F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(F.col(_ID), 33)
    # One row per partition, whatever the size of the table.
    sizes = placed.groupBy(part.alias(_PART)).agg(F.count(F.lit(1)).alias("n")).orderBy(_PART).collect()
    starts, seen = [], 0
    for row in sizes:
        starts.append((row[_PART], seen))
        seen += row["n"]
    offsets = spark.createDataFrame(starts, f"{_PART} bigint, __start bigint")
    return (
        placed.withColumn(_PART, part)
        .join(F.broadcast(offsets), _PART)
        .withColumn(_POS, F.col("__start") + F.col(_ID).bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn(_SLICE, F.expr(f"{_POS} div {slice_rows}"))
        .drop(_PART, "__start", _ID)
    )


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, total: int | None) -> DataFrame:
    """The rows with place and slice, laid out unless they carry their places."""
    if _POS in df.columns:
        return df.withColumn(_SLICE, F.expr(f"{_POS} div {size}"))
    return _numbered(df, keys, order, size, total)


def _without_place(df: DataFrame, given: DataFrame) -> DataFrame:
    """``df`` without slices, and without places unless the frame it was made from had come with them."""
    return df.drop(_SLICE) if _POS in given.columns else df.drop(_SLICE, _POS)


def _slice_window(keys: Sequence[str], descending: bool = False) -> WindowSpec:
    position = F.col(_POS).desc() if descending else F.col(_POS).asc()
    return Window.partitionBy(F.col(_SLICE), *[c(k) for k in keys]).orderBy(position)


def over_rows(
    df: DataFrame,
    build: Callable[[WindowSpec], Stage | list[Stage]],
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    layout: Layout = AUTO,
) -> DataFrame:
    """Add columns computed over frames that reach at most ``before``/``after`` rows away.

    ``build`` gets the window and returns the new columns, or a list of such steps when a later
    column is a window over an earlier one (``before`` is then the sum of the reaches).
    """

    def add(frame: DataFrame, w: WindowSpec) -> DataFrame:
        stages = build(w)
        for stage in [stages] if isinstance(stages, dict) else stages:
            frame = frame.withColumns(stage)
        return frame

    grouped, total = _choose(df, keys, layout)
    if grouped:
        return _without_tie(add(_tied(df, keys, order), _window(keys, order)), df)

    size = max(layout.slice_rows, before, after, 1)
    rows = _sliced(df, keys, order, size, total)
    place = F.expr(f"{_POS} % {size}")
    homes = [F.col(_SLICE)]
    if before:
        homes.append(F.when(place >= size - before, F.col(_SLICE) + 1))
    if after:
        homes.append(F.when(place < after, F.col(_SLICE) - 1))
    spread = rows.withColumn(_OWN, F.col(_SLICE)).withColumn(
        _SLICE, F.explode(F.array_compact(F.array(*homes)))
    )
    done = add(spread, _slice_window(keys))
    return _without_place(done.where(F.col(_OWN) == F.col(_SLICE)).drop(_OWN), df)


def _carry(
    rows: DataFrame,
    keys: Sequence[str],
    size: int,
    summary: Stage,
    combine: Callable[[str], Callable[[WindowSpec], Column]],
    forward: bool,
) -> DataFrame:
    """One row per slice whose border series goes on in the next (or previous) slice.

    ``summary`` describes a (slice, key) group; ``combine`` folds the summaries of all slices
    before it. The table has at most one row per slice.
    """
    edge = F.expr(f"__edge % {size}") == (size - 1 if forward else 0)
    groups = (
        rows.groupBy(F.col(_SLICE), *[c(k) for k in keys])
        .agg(
            (F.max(_POS) if forward else F.min(_POS)).alias("__edge"),
            *[expr.alias(name) for name, expr in summary.items()],
        )
        .where(edge)
    )
    ranked = F.col(_SLICE).asc() if forward else F.col(_SLICE).desc()
    partition = [c(k) for k in keys]
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))).orderBy(
        ranked
    ).rowsBetween(Window.unboundedPreceding, 0)
    step = 1 if forward else -1
    return groups.withColumns({n: combine(n)(w) for n in summary}).select(
        (F.col(_SLICE) + step).alias(_SLICE), *partition, *[c(n) for n in summary]
    )


def _by_slice(rows: DataFrame) -> DataFrame:
    """Bring each slice together once; the windows and the border join below both use that."""
    return rows.repartition(F.col(_SLICE))


def _add_border(rows: DataFrame, border: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Join the one border row of each slice, and keep its values for the series that goes on."""
    renamed = border.withColumnsRenamed({_SLICE: "__to", **{k: f"__k{i}" for i, k in enumerate(keys)}})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & c(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(renamed, F.col(_SLICE) == F.col("__to"), "left")
    out = joined.withColumns({n: F.when(F.col("__to").isNotNull() & same, F.col(n)) for n in names})
    return out.drop("__to", *[f"__k{i}" for i in range(len(keys))])


def number_rows(
    df: DataFrame,
    name: str = "rn",
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    descending: bool = False,
    layout: Layout = AUTO,
) -> DataFrame:
    """Add the exact 1-based row number within each key, from the start or from the end."""
    grouped, total = _choose(df, keys, layout)
    if grouped:
        w = _window(keys, order, descending)
        numbered = _tied(df, keys, order).withColumn(name, F.row_number().over(w).cast("bigint"))
        return _without_tie(numbered, df)
    if _POS in df.columns:
        ends = df.groupBy(*[c(k) for k in keys]).agg((F.max(_POS) if descending else F.min(_POS)).alias("__end"))
        return attach(df, ends, keys).withColumn(name, F.abs(F.col(_POS) - F.col("__end")) + 1).drop("__end")
    rows = _numbered(df, keys, order, layout.slice_rows, total, descending)
    if not keys:
        return rows.withColumn(name, F.col(_POS) + 1).drop(_POS, _SLICE)
    earlier = _carry(
        rows,
        keys,
        layout.slice_rows,
        {"__n": F.count(F.lit(1))},
        lambda n: lambda w: F.sum(n).over(w),
        forward=True,
    )
    inside = _by_slice(rows).withColumn(
        name, F.row_number().over(_slice_window(keys)).cast("bigint")
    )
    return (
        _add_border(inside, earlier, keys, ["__n"])
        .withColumn(name, c(name) + F.coalesce(F.col("__n"), F.lit(0)))
        .drop("__n", _POS, _SLICE)
    )


def fill_gaps(
    df: DataFrame,
    values: Sequence[str],
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    how: str = "forward",
    layout: Layout = AUTO,
) -> DataFrame:
    """Replace nulls by the nearest earlier value, the nearest later one, or both in that order."""
    if how not in ("forward", "back", "both"):
        raise ValueError(f"unknown fill direction: {how}")
    directions = {"forward": [True], "back": [False], "both": [True, False]}[how]
    grouped, total = _choose(df, keys, layout)
    if _POS in df.columns and not df.where(reduce(or_, [c(v).isNull() for v in values], F.lit(False))).take(1):
        return df
    rows = _tied(df, keys, order) if grouped else _sliced(df, keys, order, layout.slice_rows, total)
    up = _window(keys, order) if grouped else _slice_window(keys)
    down = _window(keys, order, descending=True) if grouped else _slice_window(keys, descending=True)

    def nearest(col: Column, forward: bool) -> Column:
        if forward:
            return F.last(col, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
        if how == "both":
            # What is still null after the forward fill has no earlier value, so the next value is
            # the first one of all; that frame needs no second sort.
            return F.first(col, ignorenulls=True).over(
                up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
        # Growing frames cost one step per row only when they grow from the start of the window,
        # so the later values are put first.
        return F.last(col, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))

    tag = {v: f"__f{i}" for i, v in enumerate(values)}
    found = {f"{tag[v]}{'f' if d else 'b'}": nearest(c(v), d) for v in values for d in directions}
    out = (rows if grouped else _by_slice(rows)).withColumns(found)
    carried: list[str] = []
    if not grouped:
        for d in directions:
            mark = "p" if d else "s"
            order_of = F.max_by if d else F.min_by
            border = _carry(
                rows,
                keys,
                layout.slice_rows,
                {f"{tag[v]}{mark}": order_of(c(v), F.when(c(v).isNotNull(), F.col(_POS))) for v in values},
                lambda n: lambda w: F.last(F.col(n), ignorenulls=True).over(w),
                forward=d,
            )
            out = _add_border(out, border, keys, [f"{tag[v]}{mark}" for v in values])
            carried.append(mark)

    def pick(v: str) -> Column:
        options = []
        for d in directions:
            options.append(F.col(f"{tag[v]}{'f' if d else 'b'}"))
            if not grouped:
                options.append(F.col(f"{tag[v]}{'p' if d else 's'}"))
        return F.coalesce(*options)

    out = out.withColumns({v: pick(v) for v in values})
    extra = [*found, *[f"{tag[v]}{m}" for v in values for m in carried]]
    return _without_tie(_without_place(out.drop(*extra), df), df)


def tail_rows(
    df: DataFrame,
    n: int,
    *,
    keys: Sequence[str] = (),
    order: Sequence[str],
    layout: Layout = AUTO,
) -> DataFrame:
    """The last ``n`` rows of each key.

    Without keys this is a distributed top-n. With keys, Spark limits each key on the map side
    (``WindowGroupLimit``); a key too large for one task is first thinned in salted groups.
    """
    latest = [c(o).desc() for o in [*order, _TIE]]
    given, df = df, _tied(df, keys, order)
    if not keys:
        return _without_tie(df.orderBy(*latest).limit(n), given)
    by = [c(k) for k in keys]

    def keep(frame: DataFrame, partition: list[Column]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(*latest)
        return frame.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")

    salts = 1
    if layout.how != "grouped":
        layout = _sized(df, keys, layout)
        if layout.how == "sliced" or layout.largest > layout.limit:
            salts = min(1024, max(16, ceil(layout.largest / layout.limit)))
    if salts > 1:
        # The input partition is part of the salt, so that copies of one stamp spread out too.
        mixed = F.xxhash64(*[c(o) for o in order], F.spark_partition_id())
        salt = F.pmod(mixed, F.lit(salts))
        df = keep(df.withColumn("__salt", salt), [*by, F.col("__salt")]).drop("__salt")
    return _without_tie(keep(df, by), given)
