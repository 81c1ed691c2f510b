"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and, so that inflected and compound forms meet, 5-grams of the letters of a word
(with the blank before and after). All terms of the examples are kept. A term's idf is weighed by the size
of its correlation with the label (phi, at least one over the examples): by idf alone, texts of one topic
or language are nearest, whatever their label. Only a text without any term of an example has no neighbour.

Index: postings by term, and the largest weight of each term in each block of alike examples. A text adds up
the largest weights per block, scores the most promising blocks, and then every block whose bound reaches
the k-th similarity so far; no other can hold a neighbour. Texts are asked in batches, so that the terms
that stand in many examples are multiplied as matrices. Ties go to the smaller id. The neighbours' similarities, summed by label, are
the votes, and a logistic curve fitted to the leave-one-out votes of the examples turns them into a
probability. The nearest ids are evidence.

Bound: about ``examples`` labelled rows that are in the documents, chosen by a hash of the id, whole texts.
Beyond that a label with fewer than half of them keeps all its rows, and the curve is moved back to the
labels' shares before the choice. Equal texts with equal
labels count once. Null and empty texts have no terms. Labels of one id that disagree are averaged.
With labels of one class every score is that class's smoothed share, without labels 0. Rows are kept
one for one; columns that ``score`` adds replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import spread
from tidegauge.llm.common import hash_below, sliced, texts_of
from tidegauge.llm.language import ngrams, words
from tidegauge.llm.linear import logistic, margin, sigmoid
from tidegauge.session import cut


@dataclass(frozen=True)
class Settings:
    examples: int = 1_200
    orders: tuple[int, ...] = (5,)
    neighbours: int = 15
    block: int = 32
    #: Blocks scored before the first bound is drawn.
    first: int = 4
    #: Texts asked at a time, and the share of the examples from which on a term is multiplied densely.
    batch: int = 256
    dense: float = 0.06


def terms_of(texts: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all terms and the text of each."""
    grams, gram_owner, _ = ngrams(texts, orders)
    whole, word_owner = words(texts)
    return np.concatenate([grams, whole]), np.concatenate([gram_owner, word_owner])


class Terms:
    """The kept terms (sorted keys) with their idf, and vectors of texts over them."""

    def __init__(self, keys: np.ndarray, idf: np.ndarray, orders: tuple[int, ...]):
        self.keys, self.idf, self.orders = keys, idf, orders
        self._seen = np.zeros(1 << 23, bool)
        self._seen[(keys & np.uint64((1 << 23) - 1)).astype(np.int64)] = True

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors as flat (text, term, weight), ordered by text and term."""
        keys, owner = terms_of(texts, self.orders)
        maybe = self._seen[(keys & np.uint64((1 << 23) - 1)).astype(np.int64)]
        keys, owner = keys[maybe], owner[maybe]
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        term = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        real = self.keys[term] == keys
        pair, times = np.unique(owner[real] * len(self.keys) + term[real], return_counts=True)
        row, term = pair // len(self.keys), pair % len(self.keys)
        weight = (1 + np.log(times)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight**2, minlength=len(texts)))
        return row, term, weight / norm[row]


@dataclass
class Index:
    """Postings by term: positions of the examples that hold it, and its weight in each."""

    ids: np.ndarray
    labels: np.ndarray
    settings: Settings
    start: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, settings: Settings) -> Index:
        """From flat vectors, ordered by example and term."""
        n = len(ids)
        bounds = np.searchsorted(row, np.arange(n + 1))
        own = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lead = np.array([term[x][np.argmax(weight[x])] if x.stop > x.start else terms for x in own], np.int64)
        order = np.lexsort((ids, lead))  # alike examples side by side: by their heaviest term
        vectors = ((ids[at], labels[at], term[own[at]], weight[own[at]]) for at in order)
        return Index.gather(vectors, np.bincount(term, minlength=terms), n, settings)

    @staticmethod
    def gather(vectors: Iterable[tuple], sizes: np.ndarray, most: int, settings: Settings) -> Index:
        """From (id, label, terms, weights) one by one, ``most`` at most; ``sizes`` has the number of examples of each term."""
        start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        # one example after the other, so that beside the index no copy of the postings is held
        free, rows, weights = start[:-1].copy(), np.empty(start[-1], np.uint16 if most < 1 << 16 else np.int32), np.empty(start[-1], np.float32)
        ids, labels = [], []
        for place, (name, label, term, weight) in enumerate(vectors):
            slot = free[term]
            rows[slot], weights[slot] = place, weight
            free[term] += 1
            ids.append(name)
            labels.append(label)
        return Index(np.array(ids, np.int64), np.array(labels, np.int64), settings, start, rows, weights)

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, ...]:
        """Largest weights per term and block: of frequent terms as a matrix, with their weights in all
        examples; of the others as runs: first run of each term, and block and largest weight of each."""
        n, size, block = len(self.ids), np.diff(self.start), self.settings.block
        slot = np.full(len(size), -1)
        often = np.flatnonzero(size >= max(1, self.settings.dense * n))
        slot[often] = np.arange(len(often))
        held = np.zeros((len(often), self.blocks * block))
        at = spread(self.start[often], size[often])
        held[np.repeat(np.arange(len(often)), size[often]), self.row[at]] = self.weight[at]
        top = held.reshape(len(often), self.blocks, block).max(axis=2)
        term = np.repeat(np.arange(len(size)), size)
        of = self.row // block
        rare = slot[term] < 0
        new = np.r_[True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])] if len(term) else np.empty(0, bool)
        start = np.flatnonzero(new)
        most = np.maximum.reduceat(self.weight, start) if len(start) else np.empty(0)
        start, most = start[rare[start]], most[rare[start]]
        return slot, held, top, np.searchsorted(term[start], np.arange(len(size) + 1)), of[start].astype(np.int64), most

    blocks = property(lambda self: -(-len(self.ids) // self.settings.block))

    def nearest_of(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, but: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and similarities (above zero) of the nearest examples of each vector, by block bounds.

        Vector i is ``bounds[i]`` to ``bounds[i + 1]`` of ``term`` and ``weight``; ``but[i]`` is left out (a position).
        First the blocks of the largest bounds are scored, then every other whose bound reaches the k-th
        similarity so far."""
        for first in range(0, len(bounds) - 1, self.settings.batch):
            ends = bounds[first : first + self.settings.batch + 1]
            own = slice(ends[0], ends[-1])
            yield from self._batch(ends - ends[0], term[own], weight[own], None if but is None else but[first : first + len(ends) - 1])

    def _batch(self, ends: np.ndarray, term: np.ndarray, weight: np.ndarray, but: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        slot, held, top, run_at, run_block, run_top = self._bounds
        texts, blocks, k = len(ends) - 1, self.blocks, self.settings.neighbours
        query = np.repeat(np.arange(texts), np.diff(ends))
        on = slot[term] >= 0
        asked = np.zeros((texts, len(held)))
        asked[query[on], slot[term[on]]] = weight[on]
        query, term, weight = query[~on], term[~on], weight[~on]
        count = run_at[term + 1] - run_at[term]
        runs = spread(run_at[term], count)
        rare = np.bincount(np.repeat(query, count) * blocks + run_block[runs], np.repeat(weight, count) * run_top[runs], minlength=texts * blocks)
        bound = asked @ top + rare.reshape(texts, blocks)
        size = self.start[term + 1] - self.start[term]
        at = spread(self.start[term], size)
        met, share = np.repeat(query, size), np.repeat(weight, size) * self.weight[at]
        rows = self.row[at].astype(np.int64)

        def score(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Text, example and similarity of all examples in the chosen blocks of each text."""
            block = self.settings.block
            who, which = np.nonzero(chosen)
            pair = np.full(chosen.shape, -1)
            pair[who, which] = np.arange(len(who))
            sims = np.zeros((len(who), block))
            for b in np.unique(which):
                some = np.flatnonzero(chosen[:, b])
                sims[pair[some, b]] = asked[some] @ held[:, b * block : (b + 1) * block]
            place = pair[met, rows // block]
            there = place >= 0
            sims += np.bincount(place[there] * block + rows[there] % block, share[there], minlength=sims.size).reshape(sims.shape)
            where, column = np.nonzero(sims > 0)
            found = which[where] * block + column
            if but is not None:
                other = found != but[who[where]]
                where, column, found = where[other], column[other], found[other]
            return who[where], found, sims[where, column]

        def kth(text: np.ndarray, sim: np.ndarray) -> np.ndarray:
            order = np.lexsort((-sim, text))
            start = np.searchsorted(text[order], np.arange(texts + 1))
            full = np.diff(start) >= k
            out = np.zeros(texts)
            out[full] = sim[order][start[:-1][full] + k - 1]
            return out

        chosen = np.zeros(bound.shape, bool)
        lead = np.argsort(-bound, axis=1, kind="stable")[:, : self.settings.first]
        np.put_along_axis(chosen, lead, True, axis=1)
        text, found, sim = score(chosen & (bound > 0))
        more = (bound > 0) & ~chosen & (bound >= kth(text, sim)[:, None] - 1e-9)
        text, found, sim = (np.r_[x, y] for x, y in zip((text, found, sim), score(more), strict=True))
        order = np.lexsort((self.ids[found], -np.round(sim, 12), text))
        start = np.searchsorted(text[order], np.arange(texts + 1))
        for a, b in zip(start[:-1], start[1:], strict=True):
            best = order[a : min(b, a + k)]
            yield found[best], sim[best]

    def votes(self, at: np.ndarray, sim: np.ndarray) -> tuple[float, float]:
        return float(sim @ self.labels[at]), float(sim @ (1 - self.labels[at]))


@dataclass
class Model:
    terms: Terms
    index: Index
    curve: np.ndarray
    #: Terms and index as they were shipped for the fit, so that scoring ships only the curve.
    shared: tuple[Broadcast, Broadcast] | None = None

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Probability, nearest ids and similarities of each text."""
        row, term, weight = self.terms.vectors(texts)
        starts = np.searchsorted(row, np.arange(len(texts) + 1))
        votes = np.zeros((len(texts), 2))
        ids, sims = [], []
        for at, (near, sim) in enumerate(self.index.nearest_of(starts, term, weight)):
            votes[at] = self.index.votes(near, sim)
            ids.append(self.index.ids[near])
            sims.append(sim)
        return sigmoid(margin(votes, self.curve)), ids, sims


def _document_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """Per term: examples with label 1 and with label 0 that hold it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            keys, owner = terms_of(texts_of(part, "text"), settings.orders)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            once = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])] if len(keys) else np.empty(0, bool)
            keys, label = keys[once], part.column("y").to_numpy()[owner[once]]
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(keys)])
            ones = np.add.reduceat(label.astype(np.int64), start) if len(start) else np.empty(0, np.int64)
            columns = [pa.array(keys[start].view(np.int64)), pa.array(ones, pa.int64()), pa.array(size - ones, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "ones", "zeros"])

    counted = texts.select("y", "text").mapInArrow(count, "term long, ones long, zeros long")
    return counted.groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _shares(ones: int, zeros: int, size: int) -> tuple[float, float]:
    """Share to take of either label for about ``size`` rows: half of them each, or all there are of a rarer one."""
    if ones + zeros <= size:
        return 1.0, 1.0
    most = [max(size // 2, size - other) for other in (zeros, ones)]
    return min(1.0, most[0] / max(1, ones)), min(1.0, most[1] / max(1, zeros))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` names."""
    settings = settings or Settings()
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id"))
    named = named.agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    there = docs.select(F.col(key).alias("id")).where(F.col(key).isNotNull()).distinct().join(named, "id")
    counts = {r["y"]: r["count"] for r in there.groupBy("y").count().collect()}
    shares = _shares(counts.get(1, 0), counts.get(0, 0), settings.examples)
    share = F.when(F.col("y") == 1, shares[0]).otherwise(shares[1])
    picked = F.broadcast(there.where((share >= 1) | hash_below(F.col("id"), share, 17)))  # about ``examples`` rows
    moved = np.log(shares[0] / shares[1])
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "id")
    examples = cut(own.groupBy("text", "y").agg(F.min("id").alias("id")), "toxic-examples")

    sizes = {r["y"]: r["count"] for r in examples.groupBy("y").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    total = ones + zeros
    if not ones or not zeros:
        share = (ones + 0.5) / (total + 1) if ones else (0.5 / (total + 1) if total else 1e-9)
        terms = Terms(np.empty(0, np.uint64), np.empty(0), settings.orders)
        nothing = np.empty(0, np.int64)
        index = Index.build(nothing, nothing, nothing, nothing, np.empty(0), 0, settings)
        return Model(terms, index, np.array([0.0, 0.0, np.log(share / (1 - share))]))
    both = F.col("ones") + F.col("zeros")
    counts = _document_counts(examples, settings).select("term", F.col("ones").cast("int"), both.cast("int").alias("df")).toPandas()  # bounded by the examples' terms
    keys = counts["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    df, held = counts["df"].to_numpy(float)[order], counts["ones"].to_numpy(float)[order]
    # correlation of holding the term with the label; terms of all examples have none
    spread_ = np.sqrt(float(ones) * zeros * df * (total - df))
    phi = np.abs(held * zeros - (df - held) * ones) / np.maximum(spread_, 1.0)
    idf = (np.log((total + 1) / (df + 1)) + 1) * np.maximum(phi, 1 / total)
    terms = Terms(keys[order], idf, settings.orders)
    examples_of = df.astype(np.int64)
    del counts, order, df, held, spread_, phi
    shared_terms = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            row, term, weight = shared_terms.value.vectors(texts_of(part, "text"))
            starts = np.searchsorted(row, np.arange(part.num_rows + 1))
            columns = [part.column("id"), part.column("y"), part.column("mark")]
            for flat in (term.astype(np.int32), weight.astype(np.float32)):
                columns.append(pa.array([flat[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "mark", "term", "weight"])

    marked = examples.select(F.col("id").cast("long").alias("id"), "y", "text", F.xxhash64("text", "y").alias("mark"))
    marked = marked.repartition(max(1, total // 500), "mark")
    # an example without terms is nobody's neighbour
    filled = marked.mapInArrow(vectors, "id long, y int, mark long, term binary, weight binary").where("length(term) > 0")
    # the examples are bounded; alike ones stand side by side: of one label, by their heaviest term
    vectors_of = [(r["mark"], r["id"], r["y"], np.frombuffer(r["term"], np.int32), np.frombuffer(r["weight"], np.float32)) for r in filled.toLocalIterator()]
    vectors_of.sort(key=lambda x: (x[2], x[3][np.argmax(x[4])], x[1]))
    marks = [x[0] for x in vectors_of]
    index = Index.gather((x[1:] for x in vectors_of), examples_of, total, settings)
    del vectors_of
    by_mark = np.argsort(np.array(marks, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast((index, np.array(marks, np.int64)[by_mark], by_mark))

    def leave_one_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_, marks_, places = shared.value
        for part in sliced(batches, "text"):
            row, term, weight = shared_terms.value.vectors(texts_of(part, "text"))
            starts = np.searchsorted(row, np.arange(part.num_rows + 1))
            # one without terms has no place, and nothing to leave out
            at = np.minimum(np.searchsorted(marks_, part.column("mark").to_numpy()), len(marks_) - 1)
            votes = np.array([index_.votes(*x) for x in index_.nearest_of(starts, term, weight, places[at])]).reshape(-1, 2)
            columns = [part.column("mark"), part.column("y"), pa.array(votes[:, 0]), pa.array(votes[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "y", "ones", "zeros"])

    if not marks:  # only texts without terms: the base rate
        return Model(terms, index, np.array([0.0, 0.0, np.log(ones / zeros) - moved]))
    polled = marked.mapInArrow(leave_one_out, "mark long, y int, ones double, zeros double").toPandas().sort_values("mark")
    curve = logistic(polled[["ones", "zeros"]].to_numpy(float), polled["y"].to_numpy(float), l2=1e-4, steps=2000)
    curve[-1] -= moved
    return Model(terms, index, curve, (shared_terms, shared))


ADDED = (("score", "double"), ("nearest", "array<bigint>"), ("similarity", "array<double>"))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``df`` except ``text``, with the score and its evidence."""
    kept = [c for c in df.columns if c != text and c not in dict(ADDED)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in ADDED]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *extra).schema
    context, curve = df.sparkSession.sparkContext, model.curve
    shared_terms, shared = model.shared or (context.broadcast(model.terms), context.broadcast((model.index,)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(shared_terms.value, shared.value[0], curve)
        for part in sliced(batches, "__text"):
            chance, ids, sims = here.score(texts_of(part, "__text"))
            columns = [*part.columns[:-1], pa.array(chance), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
