"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into ``m`` segments of about log2(n) bits; the index holds one row per distinct code and
segment. In turn t every query that is still open looks up all segment values at t flipped bits, in
small turns all segments at once, in large ones one segment after the other. When j segments have
been searched to radius t and the others to t - 1, any code not yet seen differs from the query in at
least t + 1 bits of those j and t bits of the others, so all codes closer than m t + j have been
verified: a query is closed once its k-th neighbour is among them. The radii grow until all queries are
closed; nothing is missed and nothing is guessed.

Neighbours are ordered by distance and then by id; a query is not its own neighbour. Equal codes are
indexed once, with their k + 1 smallest ids, which is all that k neighbours can need. Rows with a null
id or a vector that is null, not of 64 components, or holding nulls or NaN have no code and take no part.
Repeated rows of one id count once. With fewer than k other codes, all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import cut

BITS = 64
#: Flip masks up to this many are sent to all executors (8 MB); beyond it Spark shuffles them.
_BROADCAST_MASKS = 1_000_000
#: A turn with more flip masks per segment than this searches one segment at a time.
_LARGE_TURN = 1_000


def sign_codes(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``id`` and ``code``: bit i is set where component i is positive."""
    bit = F.aggregate(
        F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )
    sound = (F.size(vector) == BITS) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.where(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), bit.alias("code"))


def _segments(count: int) -> list[tuple[int, int]]:
    """Offset and width of each segment for ``count`` distinct codes."""
    m = max(1, min(16, round(BITS / max(4.0, log2(max(2, count))))))
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(code: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(code, offset).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))


def _by_segment(df: DataFrame, segments: list[tuple[int, int]], code: str) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("segment"), F.lit(w).alias("width"), _value(F.col(code), o, w).alias("value"))
        for i, (o, w) in enumerate(segments)
    ]
    return df.select("*", F.inline(F.array(*rows)))


def nearest(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``neighbour_id``, ``distance`` for all queries.

    Both inputs have ``id`` and ``code``.
    """
    per_code = Window.partitionBy("code").orderBy("id")
    # Spark keeps the first rows of each code on the map side already
    ids = cut(codes.distinct().select("*", F.row_number().over(per_code).alias("n")).where(F.col("n") <= k + 1), "codes")
    distinct = ids.groupBy("code").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held"))
    count = ids.where(F.col("n") == 1).count()
    segments = _segments(count)
    m = len(segments)
    index = cut(_by_segment(distinct, segments, "code").drop("width"), "segments")
    open_ = cut(queries.select(F.col("code").alias("query")).distinct(), "open")
    best, closed = None, []
    ranked = Window.partitionBy("query").orderBy("distance", "least")
    for turn, some in _turns(segments):
        found = _look_up(open_, index, segments, turn, some)
        if best is not None:
            found = found.unionByName(best)
        best = found.select("*", F.row_number().over(ranked).alias("n")).where(F.col("n") <= k + 1).drop("n")
        best = cut(best, "best")
        proven = F.sum(F.when(F.col("distance") < m * turn + some[-1] + 1, F.col("held")).otherwise(0))
        done = best.groupBy("query").agg(proven.alias("proven")).where(F.col("proven") >= k + 1).select("query")
        closed.append(best.join(done, "query", "left_semi"))
        open_ = cut(open_.join(done, "query", "left_anti"), "open")
        if not open_.take(1):
            break
        best = cut(best.join(done, "query", "left_anti"), "best")
    else:
        closed.append(best)  # everything has been seen
    answer = closed[0]
    for part in closed[1:]:
        answer = answer.unionByName(part)
    owners = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    full = answer.join(ids.select("code", F.col("id").alias("neighbour_id")), "code")
    top = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    full = full.select("query", "distance", "neighbour_id", F.row_number().over(top).alias("n")).where(F.col("n") <= k + 1)
    pairs = owners.join(full, "query").where(F.col("query_id") != F.col("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.select("query_id", rank.alias("rank"), "neighbour_id", "distance").where(F.col("rank") <= k)


def _turns(segments: list[tuple[int, int]]) -> Iterator[tuple[int, list[int]]]:
    """Radius and the segments that are searched to it together, in order."""
    widest = max(w for _, w in segments)
    every = list(range(len(segments)))
    for turn in range(widest + 1):
        yield from ((turn, [i]) for i in every) if comb(widest, turn) > _LARGE_TURN else [(turn, every)]


def _look_up(
    open_: DataFrame, index: DataFrame, segments: list[tuple[int, int]], turn: int, some: list[int]
) -> DataFrame:
    """Codes that the open queries meet at ``turn`` flips in one of ``some`` segments, each once, verified."""
    spark = open_.sparkSession
    widths = sorted({segments[i][1] for i in some if segments[i][1] >= turn})
    masks = [(w, sum(1 << b for b in bits)) for w in widths for bits in combinations(range(w), turn)]
    flips = spark.createDataFrame(masks, "width int, mask long")
    if sum(comb(w, turn) for w in widths) <= _BROADCAST_MASKS:
        flips = F.broadcast(flips)
    probes = _by_segment(open_, segments, "query").where(F.col("segment").isin(some)).join(flips, "width")
    probes = probes.select("query", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    met = probes.join(index, ["segment", "value"])
    # the segment that reports a pair: the first one with the fewest flips
    apart = F.col("query").bitwiseXOR(F.col("code"))
    flipped = F.array(*[F.bit_count(_value(apart, o, w)) for o, w in segments])
    fewest = F.array_min(flipped)
    first = (fewest == turn) & (F.array_position(flipped, fewest) == F.col("segment") + 1)
    return met.where(first).select("query", "code", F.bit_count(apart).alias("distance"), "least", "held")
