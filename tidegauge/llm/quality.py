"""Quality classifier by co-training of two views.

One classifier sees the text's content: hashed character trigrams with case and marks. The other sees
the page's metadata: source, language, length and layout (lines, repeated lines, and the shares of
capitals, digits, marks, blanks and repeated words). Both start from the labelled sample. In each round either view
labels those unlabelled documents that it is surest of, and the other view learns from them. In the
end a held-back part of the labels calibrates the views and their combination, which scores every row.

Bounds: about ``labelled`` labelled and ``unlabelled`` further documents, chosen by a hash of the id,
are used for fitting, whole texts; their feature rows of fixed width come to the driver.

Nulls: a null text is empty; null language or source is a value of its own. Repeated labels of one id
are averaged. Rows are kept one for one. With labels of one class (or none) every score is that
class's smoothed share (without labels 1). Columns that ``score`` adds replace columns of their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import hash_below, sliced, texts_of
from tidegauge.llm.language import mixed
from tidegauge.llm.linear import logistic, margin, sigmoid


@dataclass(frozen=True)
class Settings:
    labelled: int = 5_000
    unlabelled: int = 4_000
    rounds: int = 4
    #: Share of the unlabelled sample that a view may label in a round.
    share: float = 0.1
    #: A pseudo-label needs at least this probability.
    sure: float = 0.9
    width: int = 1024
    names: int = 64
    bins: int = 8


#: Numbers of the metadata view, in order.
LAYOUT = (
    "length", "lines", "line_length", "repeated_lines", "capitals", "digits", "marks", "blanks",
    "words_as_before", "distinct_words",
)


def content(texts: list[str], width: int) -> np.ndarray:
    """Unit vectors of damped counts of hashed character trigrams."""
    lengths = np.array([len(x) + 2 for x in texts], np.int64)
    codes = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros((len(texts), width), np.float32)
    if len(codes) > 2:
        key = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
        slot = (mixed(key) & np.uint64(width - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)[:-2]
        out = np.log1p(np.bincount(owner * width + slot, minlength=out.size)).astype(np.float32).reshape(out.shape)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def layout(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), len(LAYOUT)), np.float32)
    for at, text in enumerate(texts):
        if not text:
            continue
        n = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lines = text.split("\n")
        ascii_ = np.bincount(codes[codes < 128], minlength=128)
        capitals, digits = ascii_[65:91].sum(), ascii_[48:58].sum()
        blanks = ascii_[[9, 10, 13, 32]].sum()
        marks = ascii_[33:].sum() - capitals - digits - ascii_[97:123].sum()
        repeated = 1 - len(set(lines)) / len(lines)
        words = text.split()
        as_before = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
        sizes = np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines))
        marked = capitals / n, digits / n, marks / n, blanks / n
        rows[at] = (*sizes, repeated, *marked, as_before, len(set(words)) / max(1, len(words)))
    return rows


def _slot(kind: str, value: str | None, names: int) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % names


def metadata(texts: list[str], langs: list, sources: list, edges: np.ndarray, names: int) -> np.ndarray:
    """Indicators of the binned numbers and of hashed source and language."""
    numbers = layout(texts)
    bins = edges.shape[1] + 1
    out = np.zeros((len(texts), len(LAYOUT) * bins + names), np.float32)
    at = np.arange(len(texts))
    for k in range(len(LAYOUT)):
        out[at, k * bins + np.searchsorted(edges[k], numbers[:, k], side="right")] = 1
    tail = len(LAYOUT) * bins
    out[at, tail + np.array([_slot("lang", x, names) for x in langs], np.int64)] = 1
    out[at, tail + np.array([_slot("source", x, names) for x in sources], np.int64)] = 1
    return out


@dataclass(frozen=True)
class Model:
    content: np.ndarray
    metadata: np.ndarray
    edges: np.ndarray
    #: Calibration of each view (slope, intercept) and of both together.
    views: tuple[np.ndarray, np.ndarray]
    both: np.ndarray
    settings: Settings


def _sample(docs: DataFrame, labels: DataFrame, label: str, key: str, settings: Settings) -> DataFrame:
    """Ids and labels (null: unlabelled) of the rows to fit on; about ``labelled + unlabelled`` rows."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key)
    named = named.agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    there = docs.select(key).where(F.col(key).isNotNull()).distinct().join(named, key, "left")
    # one pass over the narrow columns counts both kinds
    total, with_label = there.agg(F.count(F.lit(1)), F.count("__y")).first()
    share = F.when(F.col("__y").isNotNull(), settings.labelled / max(1, with_label)).otherwise(
        settings.unlabelled / max(1, total - with_label)
    )
    return there.where(hash_below(F.col(key), share, 29)).select(F.col(key).alias("__id"), "__y")


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
    lang: str = "lang", source: str = "source", settings: Settings | None = None,
) -> Model:
    settings = settings or Settings()
    picked = F.broadcast(_sample(docs, labels, label, key, settings))  # about labelled + unlabelled rows
    rows = docs.select(
        F.col(key).alias("__id"), F.col(text).alias("__text"),
        F.col(lang).cast("string").alias("__lang"), F.col(source).cast("string").alias("__source"),
    ).join(picked, "__id")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "__text"):
            texts = texts_of(part, "__text")
            grams = content(texts, settings.width).astype(np.float16)
            columns = [part.column("__id").cast(pa.string()), part.column("__y"), part.column("__lang"), part.column("__source")]
            columns += [pa.array([x.tobytes() for x in grams], pa.binary()), pa.array(layout(texts).tolist(), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "lang", "source", "grams", "layout"])

    schema = "id string, y int, lang string, source string, grams binary, layout array<float>"
    got = rows.mapInArrow(features, schema).toPandas()
    got = got.sort_values(["id", "grams"], ignore_index=True)  # the same order in any partitioning
    return _co_train(got, settings)


def _co_train(got, settings: Settings) -> Model:
    grams = np.frombuffer(b"".join(got["grams"]), np.float16).reshape(-1, settings.width).astype(np.float32)
    numbers = np.array(got["layout"].tolist(), np.float32).reshape(-1, len(LAYOUT))
    cuts = np.linspace(0, 1, settings.bins + 1)[1:-1]
    edges = np.quantile(numbers, cuts, axis=0).T if len(numbers) else np.zeros((len(LAYOUT), settings.bins - 1))
    bins = settings.bins
    meta = np.zeros((len(got), len(LAYOUT) * bins + settings.names), np.float32)
    at = np.arange(len(got))
    for k in range(len(LAYOUT)):
        meta[at, k * bins + np.searchsorted(edges[k], numbers[:, k], side="right")] = 1
    for kind in ("lang", "source"):
        values = [None if x is None or x != x else x for x in got[kind].tolist()]
        slots = np.array([_slot(kind, x, settings.names) for x in values], np.int64)
        meta[at, len(LAYOUT) * bins + slots] = 1

    y = got["y"].to_numpy(float)
    known = ~np.isnan(y)
    held = known & (np.array([zlib.crc32(f"calibrate {x}".encode()) % 4 == 0 for x in got["id"]], bool))
    train, pool = known & ~held, ~known
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        share = (y[known].sum() + 1) / (known.sum() + 1)
        flat = np.array([0.0, 0.0, np.log(share / max(1e-9, 1 - share))])
        return Model(np.zeros(settings.width + 1), np.zeros(meta.shape[1] + 1), edges, (flat[1:], flat[1:]), flat, settings)

    views, weights = [grams, meta], [None, None]
    taught = [np.full(len(got), np.nan), np.full(len(got), np.nan)]  # pseudo-labels from the other view
    for turn in range(settings.rounds + 1):
        for v in (0, 1):
            own = train | ~np.isnan(taught[v])
            target = np.where(train, y, taught[v])[own]
            weights[v] = logistic(views[v][own], target, l2=1e-4 if v == 0 else 1e-3, start=weights[v], steps=200 if turn == 0 else 60)
        if turn == settings.rounds:
            break
        for v in (0, 1):
            chance = sigmoid(margin(views[v], weights[v]))
            open_ = pool & np.isnan(taught[1 - v])
            base = y[train].mean()
            for label, sure, part in ((1.0, chance, base), (0.0, 1 - chance, 1 - base)):
                best = np.flatnonzero(open_ & (sure >= settings.sure))
                best = best[np.argsort(-sure[best], kind="stable")][: int(settings.share * part * pool.sum())]
                taught[1 - v][best] = label
    logits = np.c_[margin(grams, weights[0]), margin(meta, weights[1])][held]
    views_ = tuple(logistic(logits[:, [v]], y[held], steps=400) for v in (0, 1))
    return Model(weights[0], weights[1], edges, views_, logistic(logits, y[held], steps=400), settings)


ADDED = ("content_score", "metadata_score", "score")


def score(
    df: DataFrame, model: Model, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = False
) -> DataFrame:
    """All columns of ``df`` (``text`` only if ``keep_text``) with both views' scores and the combined one."""
    kept = [c for c in df.columns if c not in ADDED and (keep_text or c != text)]
    inputs = [F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").cast("string").alias("__lang")]
    inputs.append(F.col(f"`{source}`").cast("string").alias("__source"))
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *inputs)
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name in ADDED:
        schema = schema.add(name, "double")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in sliced(batches, "__text"):
            texts = texts_of(part, "__text")
            langs, sources = part.column(len(kept) + 1).to_pylist(), part.column(len(kept) + 2).to_pylist()
            logits = np.c_[
                margin(content(texts, m.settings.width), m.content),
                margin(metadata(texts, langs, sources, m.edges, m.settings.names), m.metadata),
            ]
            found = [sigmoid(margin(logits[:, [v]], m.views[v])) for v in (0, 1)]
            found.append(sigmoid(margin(logits, m.both)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *map(pa.array, found)], schema.names)

    return rows.mapInArrow(run, schema)
