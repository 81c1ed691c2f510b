"""Packing of examples into training sequences as vector bin packing.

A sequence has limits on tokens, on segments (pieces of different examples) and on loss-bearing
tokens. One sequence is filled at a time: of the waiting examples that fit, the one is placed whose
demand has the largest dot product with what is left of the sequence, each dimension weighted by the
total demand for it. When no example fits whole, one is cut to fill the rest. Full stretches of long
examples are sequences by themselves.

Every task packs the examples it reads, so nothing is shuffled; sequence ids hold the task's number.
The pool of waiting examples is bounded. At a task's end, when less than a sequence is left, shorter
sequences of power-of-two lengths take the rest, which need no padding. A null text is empty and gives
its end id alone; repeated rows are separate examples; null keys are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import encoder, little_endian
from tidegauge.llm.common import hand_back, pieces, texts_of

#: Fragments that a worker remembers here, where it stands beside a heap that earlier stages have filled.
TABLE_LIMIT = 300_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    #: Examples that wait in a task before sequences are filled; more gives better choices.
    pool: int = 1024


@dataclass
class _Rest:
    """What is left of an example: its ids from ``start`` on."""

    key: int | None
    ids: np.ndarray
    start: int
    total: int
    loss_from: int

    def __len__(self) -> int:
        return self.total - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest piece from the front within both limits."""
        free = max(0, self.loss_from - self.start)
        return min(len(self), tokens, free + loss)


class Packer:
    """Fills sequences from a pool; ``out`` collects (rest, start, length, sequence, offset, loss)."""

    def __init__(self, limits: Limits, base: int):
        self.limits, self.next = limits, base
        self.pool: list[_Rest] = []
        self.out: list[tuple] = []

    def add(self, rest: _Rest) -> None:
        """Take full sequences off the front, then let the rest wait."""
        limits = self.limits
        while len(rest) >= limits.tokens and rest.loss(limits.tokens) <= limits.loss:
            self._place(rest, limits.tokens, self._open(), 0)
        if len(rest):
            self.pool.append(rest)

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, rest: _Rest, length: int, sequence: int, offset: int) -> None:
        piece = little_endian(rest.ids[rest.start : rest.start + length])
        self.out.append((rest.key, rest.start, length, zlib.crc32(piece), rest.total, sequence, offset, rest.loss(length)))
        rest.start += length

    def fill(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` examples wait."""
        limits = self.limits
        if len(self.pool) <= keep:
            return
        pool = self.pool
        caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        demand = np.array([(len(x), 1, x.loss(len(x))) for x in pool], float)
        alive = np.ones(len(pool), bool)
        waiting, tokens = len(pool), int(demand[:, 0].sum())
        while waiting > keep:
            # near the end only as much as is there, in lengths that need no padding
            room = limits.tokens if tokens >= limits.tokens else 1 << (tokens.bit_length() - 1)
            left = np.array([room, limits.segments, limits.loss])
            weight = demand[alive].sum(0) / caps**2
            sequence, offset = self._open(), 0
            placed: list[tuple[int, int]] = []  # places in the pool and lengths
            while left[0] > 0 and left[1] > 0 and waiting:
                fits = alive & (demand <= left).all(1)
                score = demand @ (weight * left / caps)
                if fits.any():
                    at = int(np.argmax(np.where(fits, score, -1.0)))
                    length = len(pool[at])
                else:
                    at = int(np.argmax(np.where(alive, score, -1.0)))
                    length = pool[at].fitting(int(left[0]), int(left[2]))
                    if length <= 0:
                        break
                left -= (length, 1, pool[at].loss(length))
                self._place(pool[at], length, sequence, offset)
                placed.append((at, length))
                offset += length
                tokens -= length
                demand[at] = (len(pool[at]), 1, pool[at].loss(len(pool[at])))
                if not len(pool[at]):
                    alive[at] = False
                    demand[at] = 0
                    waiting -= 1
            # closed by its segments: end on a length that needs no padding, the rest waits again
            spare = offset - (1 << (offset.bit_length() - 1)) if left[0] > 0 and left[1] <= 0 else 0
            while spare:
                at, length = placed.pop()
                back = min(spare, length)
                self.out.pop()
                pool[at].start -= length
                offset -= length
                if length > back:
                    self._place(pool[at], length - back, sequence, offset)
                spare -= back
                tokens += back
                waiting += not alive[at]
                alive[at] = True
                demand[at] = (len(pool[at]), 1, pool[at].loss(len(pool[at])))
        self.pool = [x for x, on in zip(pool, alive, strict=True) if on]

    def taken(self) -> list[tuple]:
        rows, self.out = self.out, []
        return rows


_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def pack(
    df: DataFrame,
    path: str,
    end_id: int,
    limits: Limits | None = None,
    key: str = "doc_id",
    text: str = "text",
    loss_from: str | None = None,
) -> DataFrame:
    """One row per piece: where it stands in its example and in its sequence, and its loss tokens.

    ``loss_from`` names a column with the number of leading tokens (the prompt) that bear no loss;
    without it, and where it is null, all tokens bear loss.
    """
    limits = limits or Limits()
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path, TABLE_LIMIT), Packer(limits, TaskContext.get().partitionId() << 40)

        def taken() -> pa.RecordBatch:
            rows = packer.taken()
            columns = list(zip(*rows, strict=True)) if rows else [()] * (1 + len(_COLUMNS))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [key, *_COLUMNS])

        for batch in batches:
            for part in pieces(batch, "__text"):
                flat, lengths = coder.encode(texts_of(part, "__text"))
                flat = np.insert(flat, np.cumsum(lengths), np.uint32(end_id))
                ends = np.cumsum(lengths + 1)
                keys, free = part.column(0).to_pylist(), part.column(2).to_pylist()
                for name, end, n, prompt in zip(keys, ends.tolist(), (lengths + 1).tolist(), free, strict=True):
                    packer.add(_Rest(name, flat[end - n : end], 0, n, prompt or 0))
                    if len(packer.pool) >= 2 * limits.pool:
                        packer.fill(limits.pool)
                yield taken()
            hand_back()
        packer.fill(0)
        yield taken()
        hand_back()

    loss = F.col(f"`{loss_from}`").cast("long") if loss_from else F.lit(0).cast("long")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"), loss.alias("__loss"))
    schema = ", ".join(f"`{name}` bigint" for name in [key, *_COLUMNS])
    return rows.mapInArrow(run, schema)
