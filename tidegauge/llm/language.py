"""Language identification with bit-sliced Bloom filters over n-grams.

Each slot of the filter holds one bit per language. The AND of an n-gram's slots is the mask of all
languages whose profile holds it, so one look-up asks every language at once. Per text the bits are
counted by language, each count is corrected for the filter's false positives, and the largest wins.

A profile holds the n-grams that make up at least ``1 / rarest`` of a language's n-grams; there are at
most ``rarest`` of those per order, so the filter's size depends on the number of languages alone. It is
learned from about ``per_language`` labelled rows of each language (a documented bound).

N-grams run inside words of letters in lower case, with the blank before or after. A text that is null
or has no letter is ``und`` with score 0. A text with letters of which no n-gram is known gets the first
language by name, with score 0. Equal counts go to the first name. Rows are kept one for one, repeated
ones included; an empty training set makes every text ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import sample_by_hash, sliced, texts_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4)
    per_language: int = 4_000
    rarest: int = 20_000
    hashes: int = 3
    #: Slots per n-gram of the largest profile.
    slots: int = 8


@dataclass(frozen=True)
class Model:
    """``masks`` has one row of 64-bit words per slot; bit l is language l."""

    languages: tuple[str, ...]
    masks: np.ndarray
    hashes: int
    orders: tuple[int, ...]

    @property
    def false_positive(self) -> np.ndarray:
        fill = [
            np.mean((self.masks[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)) for at in range(len(self.languages))
        ]
        return np.array(fill) ** self.hashes


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a key depend on all of its characters."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def ngrams(texts: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams, the text that each belongs to, and whether each text has a letter."""
    lowered = [x.lower() for x in texts]
    lengths = np.array([len(x) + 1 for x in lowered], np.int64)
    codes = np.frombuffer((" " + " ".join([*lowered, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    owner = np.r_[0, np.repeat(np.arange(len(texts)), lengths)]
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in orders:
        if len(codes) < n:
            continue
        inner = np.ones(len(codes) - n + 1, bool)
        for k in range(1, n - 1):
            inner &= letter[k : len(letter) - n + 1 + k]
        at = np.flatnonzero(inner)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x1FFFFF) + codes[at + k]
        keys.append(mixed(key))
        owners.append(owner[at + 1])
    return np.concatenate(keys), np.concatenate(owners), has_letter


def powers(length: int) -> np.ndarray:
    """1, p, p^2, ... modulo 2^64 for a fixed odd p."""
    out = np.full(length, 0x9E3779B97F4A7C15, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str], least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of at least ``least`` letters in lower case, and the text of each."""
    lowered = [x.lower() for x in texts]
    lengths = np.array([len(x) + 1 for x in lowered], np.int64)
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    edge = np.diff(np.r_[False, letter].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    long = end - start >= least
    start, end = start[long], end[long]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = end - start
    inner = np.repeat(start, size)
    at = np.arange(len(inner)) - np.repeat(np.cumsum(size) - size, size)
    part = mixed(codes[inner + at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at]
    return mixed(np.add.reduceat(part, np.cumsum(size) - size) + np.uint64(7)), owner[start]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Model:
    """Learn the profiles from the rows of ``df`` that have a text and a language."""
    settings = settings or Settings()
    rows = df.select(
        F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").alias("__lang")
    ).where(F.col("__text").isNotNull() & F.col("__lang").isNotNull())
    chosen = sample_by_hash(rows, "__key", settings.per_language, by="__lang")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "__text"):
            langs, texts = part.column(1).to_pylist(), texts_of(part, "__text")
            for lang_ in sorted(set(langs)):
                own = [x for x, y in zip(texts, langs, strict=True) if y == lang_]
                for n in settings.orders:
                    grams, n_each = np.unique(ngrams(own, (n,))[0], return_counts=True)
                    columns = [pa.array([lang_] * len(grams), pa.string()), pa.array(np.full(len(grams), n, np.int32))]
                    columns += [pa.array(grams.view(np.int64)), pa.array(n_each.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "n", "gram", "times"])

    counted = chosen.select("__text", "__lang").mapInArrow(count, "lang string, n int, gram long, times long")
    per_gram = counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    total = F.sum("times").over(Window.partitionBy("lang", "n"))
    found = per_gram.withColumn("total", total).where(F.col("times") * settings.rarest >= F.col("total"))
    profile = found.select("lang", "gram").toPandas()  # at most rarest rows per language and order

    languages = tuple(sorted(profile["lang"].unique()))
    largest = max([1, *profile.groupby("lang").size()])
    slots = 1 << int(np.ceil(np.log2(largest * settings.slots)))
    masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    for at, name in enumerate(languages):
        grams = profile["gram"][profile["lang"] == name].to_numpy(np.int64).view(np.uint64)
        for slot in _slots(grams, slots, settings.hashes):
            masks[slot, at // 64] |= np.uint64(1) << np.uint64(at % 64)
    return Model(languages, masks, settings.hashes, settings.orders)


def _slots(keys: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    step = (keys >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((keys + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def identify(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and coverage of each text."""
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    keys, owner, has_letter = ngrams(texts, model.orders)
    masks = None
    for slot in _slots(keys, len(model.masks), model.hashes):
        masks = model.masks[slot] if masks is None else masks & model.masks[slot]
    total = np.bincount(owner, minlength=len(texts)).astype(float)
    false = model.false_positive
    counts = np.empty((len(texts), len(model.languages)))
    for at in range(len(model.languages)):
        bit = (masks[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
        seen = np.bincount(owner[bit.astype(bool)], minlength=len(texts))
        counts[:, at] = np.maximum(0, (seen - total * false[at]) / (1 - min(false[at], 0.999)))
    best = counts.argmax(1)
    top = counts[np.arange(len(texts)), best]
    counts[np.arange(len(texts)), best] = 0
    second = counts.max(1)
    score = np.divide(top, top + second, out=np.zeros(len(texts)), where=top > 0)
    cover = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
    return names, np.where(has_letter, np.clip(score, 0, 1), 0), np.where(has_letter, np.clip(cover, 0, 1), 0)


#: What ``predict`` adds: the language, the winner's share of its count and the next one's, and the
#: share of the text's n-grams that the winner's profile holds.
ADDED = (("lang_pred", "string"), ("score", "double"), ("coverage", "double"))


def predict(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``df`` (``text`` only if ``keep_text``) with those of ``ADDED``, which replace their like."""
    kept = [c for c in df.columns if c not in dict(ADDED) and (keep_text or c != text)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in ADDED:
        schema = schema.add(name, kind)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "__text"):
            names, score, cover = identify(shared.value, texts_of(part, "__text"))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(cover)], schema.names
            )

    return rows.mapInArrow(run, schema)
