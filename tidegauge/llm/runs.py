"""Periodic runs in texts by internal pattern matching.

A run is a stretch of words with a smallest period q, at least ``shortest`` and 2q words long, that no
neighbouring word extends. Texts are worked on a slice at a time, as one sequence of word numbers in
which each text ends with a number of its own, so that no match crosses an end.

* Ranks of all stretches of 1, 2, 4, ... words (prefix doubling) order the suffixes; suffixes that start
  with the same dyadic block are neighbours in the suffix array, and a wavelet tree over the array
  answers: how many of these start before x, and which is the next from x on (range successor).
* Of a run with period q, what lies before its last period holds a block of 2^k words, where 2^k is about
  q/4 to q/2, at a multiple of 2^(k-1). The block's next occurrences in the neighbouring window, which is
  short enough for them to be one arithmetic progression, give candidate periods. Inside one run of the
  progression's difference only this difference is one, so the candidates stay few.
* Each candidate is extended to both sides by ranks of dyadic stretches; a stretch found with several
  periods keeps the least.

The first blocks have four words and serve all periods up to 14, as a run has at least twelve words. Texts
in which no four words stand twice have no run and are left out before anything else is made.

Null texts and texts without words have no runs. Keys may be null or repeated; each row is answered by
itself. Texts of any length are processed whole, in memory in proportion to the longest.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import spread
from tidegauge.llm.common import pieces

SHORTEST = 12
#: Words of the least block; ``SHORTEST`` words allow no larger one.
_BLOCK = 4
#: Candidates extended at a time.
_TURN = 1 << 18


class Wavelet:
    """Wavelet tree over the numbers 0..n-1 in some order, one level per bit, the highest first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        now = values
        for bit in range(self.bits - 1, -1, -1):
            zero = (now >> bit) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)].astype(np.int32))
            now = np.concatenate([now[zero], now[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at [low, high) are less than x, for each query."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(x), np.int64)
        over = x >> self.bits > 0
        count[over] = (high - low)[over]
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            l0, h0 = zeros[low], zeros[high]
            count += np.where(one & ~over, h0 - l0, 0)
            low = np.where(one, zeros[-1] + low - l0, l0)
            high = np.where(one, zeros[-1] + high - h0, h0)
        return count

    def least(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value at [low, high), from 0, for each query."""
        low, high, k, out = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            l0, h0 = zeros[low], zeros[high]
            one = k >= h0 - l0
            k -= np.where(one, h0 - l0, 0)
            out = out * 2 + one
            low = np.where(one, zeros[-1] + low - l0, l0)
            high = np.where(one, zeros[-1] + high - h0, h0)
        return out


class Suffixes:
    """Ranks of dyadic stretches, the suffix array and its wavelet tree; a sequence's ends are unique."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        _, rank = np.unique(words, return_inverse=True)
        #: ranks[k][i]: the order of the 2^k words from i on among all such stretches, equal where they are.
        self.ranks = [rank.astype(np.int32)]
        while True:
            half, k = self.ranks[-1].astype(np.int64), len(self.ranks) - 1
            other = np.full(self.n, -1, np.int64)
            other[: max(self.n - (1 << k), 0)] = half[1 << k :]
            key = half * (self.n + 1) + other + 1
            order = np.argsort(key, kind="stable")
            new = np.r_[False, key[order][1:] != key[order][:-1]]
            rank = np.empty(self.n, np.int32)
            rank[order] = np.cumsum(new)
            self.ranks.append(rank)
            if self.n == 0 or rank[order[-1]] == self.n - 1:
                self.array = order
                break
        self.tree = Wavelet(self.array) if self.n else None
        self.place = rank  # of each suffix in the array

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of the suffix array whose suffixes start with the 2^k words from ``at`` on."""
        along = self.ranks[k][self.array]
        rank = self.ranks[k][at]
        return np.searchsorted(along, rank), np.searchsorted(along, rank, side="right")

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a < b on are the same."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = b + (1 << k) <= self.n
            same = inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])
            a += same << k
            b += same << k
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a < b are the same."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = a >= 1 << k
            back = 1 << k
            same = inside & (self.ranks[k][np.where(inside, a - back, 0)] == self.ranks[k][np.where(inside, b - back, 1)])
            a -= same << k
            b -= same << k
        return start - a


def _windows(k: int) -> list[tuple[int, int]]:
    """Distances at which blocks of 2^k words look for themselves; no window has over 2^k + 1 places."""
    size = 1 << k
    if size == _BLOCK:
        return [(1, 4), (5, 9), (10, 14)]
    return [(2 * size - 1, 3 * size - 2), (3 * size - 1, 4 * size - 2)]


def _candidates(text: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and distances d so that a dyadic block stands at i and at i + d."""
    for k in range(_BLOCK.bit_length() - 1, len(text.ranks)):
        size = 1 << k
        at = np.arange(0, text.n - size + 1, size // 2)
        if not len(at):
            return
        low, high = text.interval(k, at)
        often = high - low > 1
        if not often.any():
            return
        at, low, high = at[often], low[often], high[often]
        for first, last in _windows(k):
            before = text.tree.below(low, high, at + first)
            count = text.tree.below(low, high, at + last + 1) - before
            some = count > 0
            i, lo, hi, skip, n = at[some], low[some], high[some], before[some], count[some]
            one = text.tree.least(lo, hi, skip) - i
            step = np.zeros(len(i), np.int64)
            more = n > 1
            step[more] = text.tree.least(lo[more], hi[more], skip[more] + 1) - i[more] - one[more]
            many = np.flatnonzero(n > 2)
            if len(many):  # one run of the step from i to the last occurrence: only the step itself counts
                same = text.forward(i[many], i[many] + step[many]) >= one[many] + size - step[many]
                n[many[same]] = one[many[same]] == step[many[same]]
            for a in range(0, len(i), _TURN):
                b = slice(a, a + _TURN)
                turn = spread(np.zeros(len(n[b]), np.int64), n[b])
                for c in range(0, len(turn), _TURN):
                    d = slice(c, c + _TURN)
                    owner = np.repeat(np.arange(len(n[b])), n[b])[d]
                    yield i[b][owner], one[b][owner] + turn[d] * step[b][owner]


def find(words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Start, length and period of every run, by start and period; ``words`` may hold many texts, each of
    which ends with a number that stands nowhere else."""
    if shortest < SHORTEST:
        raise ValueError(f"blocks of {_BLOCK} words find runs of at least {SHORTEST} words")
    text = Suffixes(words)
    found = [np.empty((0, 3), np.int64)]
    for i, d in _candidates(text):
        start = i - text.backward(i, i + d)
        length = i + d + text.forward(i, i + d) - start
        right = length >= np.maximum(shortest, 2 * d)
        found.append(np.unique(np.stack([start, length, d], axis=1)[right], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    rows = rows[np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)]] if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def with_tail(words: list[bytes], key: object) -> list[bytes]:
    """Every tenth key's words, by crc32 of the key as text, go on periodically from some word on."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each closed by an own number, and where each text starts."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    rows = [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in texts]
    ends = len(number) + np.arange(len(texts))
    parts = [y for x, end in zip(rows, ends, strict=True) for y in (x, np.array([end]))]
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in rows])]
    return np.concatenate(parts) if parts else np.empty(0, np.int64), starts


def _repeats_itself(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, whether some four words stand in it twice."""
    texts = len(starts) - 1
    out = np.zeros(texts, bool)
    if len(flat) < _BLOCK:
        return out
    size = int(flat.max()) + 1
    _, pair = np.unique(flat[:-1] * size + flat[1:], return_inverse=True)
    key = pair[:-2] * (int(pair.max()) + 1) + pair[2:]
    _, four = np.unique(key, return_inverse=True)
    owner = np.searchsorted(starts, np.arange(len(four)), side="right") - 1
    both, n = np.unique(owner * (int(four.max()) + 1) + four, return_counts=True)
    out[np.unique(both[n > 1] // (int(four.max()) + 1))] = True
    return out


def of_texts(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """The runs of each text, as start, length and period."""
    none = np.empty((0, 3), np.int64)
    flat, starts = _numbered(texts)
    some = np.flatnonzero(_repeats_itself(flat, starts))
    out = [none] * len(texts)
    if not len(some):
        return out
    size = np.diff(starts)[some]
    rows = find(flat[spread(starts[some], size)], shortest)
    begins = np.r_[0, np.cumsum(size)]
    owner = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows[:, 0] -= begins[owner]
    at = np.searchsorted(owner, np.arange(len(some) + 1))
    for j, text in enumerate(some):
        out[text] = rows[at[j] : at[j + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def runs(
    df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, tails: bool = False
) -> DataFrame:
    """Per row ``key``, ``runs`` (start, length and period of each, by start and period) and ``collapsed``,
    the words joined by one blank without those that a run holds after its first period.

    ``tails`` makes some texts periodic beforehand, see ``with_tail``; the runs are those of the texts made.
    """
    named = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    kind = F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs")
    schema = named.select("__key", kind, F.lit("").alias("collapsed")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["start", "length", "period"]
        for batch in batches:
            for part in pieces(batch, "__text"):
                texts = [(x or b"").split() for x in part.column(1).cast(pa.binary()).to_pylist()]
                if tails:
                    texts = [with_tail(x, k) for x, k in zip(texts, part.column(0).to_pylist(), strict=True)]
                found = of_texts(texts, shortest)
                flat = np.concatenate([*found, np.empty((0, 3), np.int64)])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields)
                offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                kept = [b" ".join(collapsed(x, y)) for x, y in zip(texts, found, strict=True)]
                arrays = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["__key", "runs", "collapsed"])

    return named.mapInArrow(run, schema).withColumnRenamed("__key", key)
