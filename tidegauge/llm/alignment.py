"""Two tokenizers aligned over a corpus: which ids of A stand for the same text as which ids of B.

A is a byte-level BPE file (``tokenizers``), B a piece model (``sentencepiece``) that puts a blank in
front of a text, so A reads blank + text. Byte offsets where a token of A and one of B both end cut a
text into groups. Most groups hold one token of each with the same bytes: ``Pair.same`` names, for each
id of A, the id of B with these bytes, and such a group is only counted, in a vector over the ids of A.
Pairs out of all other groups are summed in each task before they are shuffled.

Neither vocabulary has a token that goes on with a blank or a line feed after a visible character, so
a text is cut there and each distinct fragment is encoded and aligned once per worker, in a table that
is emptied when full.

The counts of pairs can outgrow memory. Those with at least a ``KNOWN``-th part of all links are at most
``KNOWN`` many and are handed to all tasks; links of rarer pairs are joined by pair, where by the same
bound no pair is hot. Per document only distinct pairs travel, with their number.

Null and empty texts, and texts whose tokens do not give back blank + text in both tokenizers, have no
tokens: zeros and an empty digest. Rows with equal or null keys stay separate rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import Encoder, Vocabulary, spread
from tidegauge.llm.common import hand_back, pieces, small_batches, texts_of
from tidegauge.session import cut

#: Bytes of text that a task aligns at a time.
ALIGN_BYTES = 2 << 20
#: Fragments that a worker remembers, and that it encodes at a time.
TABLE_LIMIT = 250_000
LEARN = 50_000
#: Distinct pairs that a task sums before it hands them on.
SUM_LIMIT = 1_000_000
#: Pair counts that every task holds; pairs with a share of the links below one KNOWN-th are joined.
KNOWN = 200_000

# White space as A's word pattern sees it (the separators \x1c to \x1f are none), and what else may follow a visible character.
_SPACE, _SEEN, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", r"[^\S\x1c-\x1f \n]"
_FRAGMENT = re.compile(rf"{_SPACE}*{_SEEN}+(?:{_OTHER}{_SPACE}*(?:{_SEEN}+|\Z))*|{_SPACE}+")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

TABLE = (
    "uid long, kind int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_n array<long>, pairs array<long>, pairs_n array<long>"
)
_NAMES = [x.split()[0] for x in TABLE.split(", ")]
_DOC, _SUMS = 0, 1


class Plain(Encoder):
    """A byte-level encoder that takes the strings of special tokens as they stand."""

    def __init__(self, path: str):
        super().__init__(Vocabulary(path))
        self.vocab.special_pattern = re.compile(r"(?!)")

    def of_fragments(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct fragments and the number of each; nothing is remembered."""
        self._clear()
        self._index.update(zip(fragments, itertools.count()))
        self._learn()
        return self._ids.astype(np.int64), self._counts


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.coder = Plain(path_a)
        vocab = self.coder.vocab
        each = np.arange(vocab.size)
        self.bytes_a = [vocab.decode(each[i : i + 1]) for i in each]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = self.b.id_to_piece(list(range(self.b.vocab_size())))
        self.bytes_b = [self._bytes(x) for x in names]
        self.blank = self.b.piece_to_id("▁")
        by_bytes = {}
        for at in range(len(names) - 1, -1, -1):
            if not _BYTE_PIECE.fullmatch(names[at]):
                by_bytes[self.bytes_b[at]] = at
        #: same[a]: the id of B with the bytes of a, or -1.
        self.same = np.array([by_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        crossing = re.compile(r"[^▁]▁|\n")
        if any(crossing.search(x) for x in names):
            raise ValueError("a piece goes on with a blank or a line feed: its texts cannot be cut there")

    @staticmethod
    def _bytes(piece: str) -> bytes:
        found = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def encode_b(self, fragments: list[str]) -> list[list[int]]:
        """Ids of B for fragments that start with a blank or a line feed, the blank in front included."""
        found = self.b.encode([x[1:] if x[0] == " " else x for x in fragments], num_threads=1)
        for at, fragment in enumerate(fragments):
            if fragment[0] != " ":  # B has put a blank in front, which no piece joins to a line feed
                found[at] = found[at][1:] if found[at][:1] == [self.blank] else []
            elif fragment == " ":  # B encodes the empty text to nothing
                found[at] = [self.blank]
        return found


class Strings:
    """Byte strings in one array, picked by number."""

    def __init__(self, strings: Iterable[bytes] = ()):
        strings = list(strings)
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def add(self, raw: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.raw) + np.cumsum(sizes) - sizes])
        self.raw, self.sizes = np.concatenate([self.raw, raw]), np.concatenate([self.sizes, sizes])

    def pick(self, at: np.ndarray) -> np.ndarray:
        return self.raw[spread(self.starts[at], self.sizes[at])]


def _sums_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values that belong to consecutive stretches of the given sizes."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(counts)]])


class Aligner:
    """Aligns texts through a bounded table of the fragments seen so far."""

    def __init__(self, pair: Pair, limit: int = TABLE_LIMIT):
        self.pair, self.limit = pair, limit
        self.size_a, self.size_b = len(pair.bytes_a), len(pair.bytes_b)
        self.of_a, self.of_b = Strings(pair.bytes_a), Strings(pair.bytes_b)
        self.decimal = Strings(b"%d," % x for x in range(max(self.size_a, self.size_b)))
        self._clear()

    def _clear(self) -> None:
        self._index: defaultdict[str, int] = defaultdict()
        self._index.default_factory = self._index.__len__
        #: Per fragment: tokens of A, of B, groups, links, one-to-one groups, other links, and 1 if the bytes differ.
        self._numbers = np.empty((0, 7), np.int64)
        self._text = Strings()
        self._same, self._other = np.empty(0, np.int64), np.empty(0, np.int64)
        self._same_at, self._other_at = np.empty(0, np.int64), np.empty(0, np.int64)

    def _right(self, raw: list[bytes], ids: np.ndarray, counts: np.ndarray, strings: Strings) -> np.ndarray:
        """Which fragments the tokens give back."""
        sizes = np.array([len(x) for x in raw])
        right = _sums_by(counts, strings.sizes[ids]) == sizes
        of = np.repeat(right, counts)
        got = strings.pick(ids[of])
        want = np.frombuffer(b"".join(x for x, ok in zip(raw, right, strict=True) if ok), np.uint8)
        off = _sums_by(sizes[right], got != want)
        right[np.flatnonzero(right)[off > 0]] = False
        return right

    def _align(self, fragments: list[str]) -> None:
        """Adds the fragments to the table, all of them at a time: they stand one after the other."""
        raw = [x.encode("utf-8", "surrogatepass") for x in fragments]
        a, n_a = self.pair.coder.of_fragments(fragments)
        lists = self.pair.encode_b(fragments)
        n_b = np.array([len(x) for x in lists], np.int64)
        b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n_b.sum()))
        right = self._right(raw, a, n_a, self.of_a) & self._right(raw, b, n_b, self.of_b)
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
        ends_a, ends_b = np.cumsum(self.of_a.sizes[a]), np.cumsum(self.of_b.sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        # Between two neighbouring ends, of A or of B, lies just one pair of overlapping tokens.
        steps = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, steps), np.searchsorted(ends_b, steps)
        one = (in_a[group_a[link_a]] == 1) & (in_b[group_a[link_a]] == 1) & (self.pair.same[a[link_a]] == b[link_b])
        fragment = np.repeat(np.arange(len(raw)), n_a)
        n_groups = np.bincount(fragment[np.searchsorted(ends_a, ends)], minlength=len(raw))
        n_one = np.bincount(fragment[link_a[one]], minlength=len(raw))
        n_other = np.bincount(fragment[link_a[~one]], minlength=len(raw))
        # Decimals in order: the ids of A of a group, then those of B, each with the sign that follows it.
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        text = self.decimal.pick(ids)
        sizes = self.decimal.sizes[ids]
        last = np.cumsum(sizes) - 1
        text[last[place_a[np.searchsorted(ends_a, ends)]]] = ord("|")
        text[last[place_b[np.searchsorted(ends_b, ends)]]] = ord(";")
        self._text.add(text, _sums_by(n_a + n_b, sizes))
        numbers = np.stack([n_a, n_b, n_groups, n_one + n_other, n_one, n_other, ~right], axis=1)
        self._numbers = np.concatenate([self._numbers, numbers])
        self._same_at = np.concatenate([self._same_at, len(self._same) + np.cumsum(n_one) - n_one])
        self._other_at = np.concatenate([self._other_at, len(self._other) + np.cumsum(n_other) - n_other])
        self._same = np.concatenate([self._same, a[link_a[one]]])
        self._other = np.concatenate([self._other, a[link_a[~one]] * self.size_b + b[link_b[~one]]])

    def _learn(self) -> None:
        known = len(self._numbers)
        fresh = list(itertools.islice(reversed(self._index), len(self._index) - known))[::-1]
        for at in range(0, len(fresh), LEARN):
            self._align(fresh[at : at + LEARN])

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], tuple, tuple]:
        """Per text the numbers and the digest of its groups; flat one-to-one ids and other pairs, each
        as (text, value, number) of the distinct values of a text."""
        if len(self._index) > self.limit:
            self._clear()
        number = self._index.__getitem__
        at = []
        for text in texts:
            parts = _FRAGMENT.findall(" " + text) if text else []
            at.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        self._learn()
        sums = np.zeros((len(texts), 7), np.int64)
        digests = []
        for i, x in enumerate(at):
            sums[i] = self._numbers[x].sum(axis=0)
            if sums[i, 6]:
                at[i], sums[i] = x[:0], 0
            joined = self._text.pick(at[i])[:-1]
            digests.append(hashlib.sha256(joined.tobytes()).hexdigest() if len(joined) else "")
        owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
        flat = np.concatenate(at) if at else np.empty(0, np.int64)

        def distinct(values: np.ndarray, starts: np.ndarray, column: int, size: int) -> tuple:
            counts = self._numbers[flat, column]
            keys = np.repeat(owner, counts) * size + values[spread(starts[flat], counts)]
            keys, n = np.unique(keys, return_counts=True)
            return keys // size, keys % size, n

        return (
            sums,
            digests,
            distinct(self._same, self._same_at, 4, self.size_a),
            distinct(self._other, self._other_at, 5, self.size_a * self.size_b),
        )


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One table per worker process."""
    return Aligner(Pair(path_a, path_b))


def _lists(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """One list per row of the values that it owns; owners are sorted."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, counts)
    return keys, out


def _sums(same: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row with what a task has counted: the vector over the ids of A, without zeros, and the pairs."""
    ids, one = np.flatnonzero(same), np.zeros(1, np.int64)
    columns = [pa.array([None], pa.int64()), pa.array([_SUMS], pa.int32()), *[pa.array(one)] * 4, pa.array([""])]
    columns += [
        _lists(np.zeros(len(x), np.int64), x, 1, t)
        for x, t in ((ids, pa.int32()), (same[ids], pa.int64()), (pairs, pa.int64()), (counts, pa.int64()))
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _aligned(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document, and rows with the sums of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(path_a, path_b)
        same = np.zeros(coder.size_a, np.int64)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "__text", ALIGN_BYTES):
                sums, digests, ones, others = coder.align(texts_of(part, "__text"))
                n = part.num_rows
                np.add.at(same, ones[1], ones[2])
                keys, counts = _merged(np.concatenate([keys, others[1]]), np.concatenate([counts, others[2]]))
                if len(keys) > SUM_LIMIT:
                    yield _sums(np.zeros(0, np.int64), keys, counts)
                    keys, counts = keys[:0], counts[:0]
                columns = [part.column(0), pa.array(np.full(n, _DOC, np.int32))]
                columns += [pa.array(sums[:, i]) for i in range(4)]
                columns.append(pa.array(digests, pa.string()))
                columns += [_lists(ones[0], ones[1], n, pa.int32()), _lists(ones[0], ones[2], n, pa.int64())]
                columns += [_lists(others[0], others[1], n, pa.int64()), _lists(others[0], others[2], n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)
            hand_back()
        yield _sums(same, keys, counts)

    return rows.select("uid", "__text").mapInArrow(run, TABLE)


def _exploded(table: DataFrame, values: str, key: str) -> DataFrame:
    both = F.explode(F.arrays_zip(F.col(values).alias("k"), F.col(f"{values}_n").alias("n")))
    return table.where(F.col("kind") == _SUMS).select(both.alias("x")).select(F.col("x.k").cast("long").alias(key), "x.n")


def align(
    df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", known: int = KNOWN
) -> tuple[DataFrame, DataFrame]:
    """Per document ``key`` and its numbers and digest of groups; and the counts of id pairs.

    The documents have ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the
    highest of their id of B), ``count_sum`` and ``groups_sha256``. The pairs have ``a``, ``b``,
    ``links`` and ``best``. ``known`` is the greatest number of pair counts that a task holds.
    """
    spark = df.sparkSession
    small_batches(spark)
    pair = Pair(path_a, path_b)
    size_b, same = len(pair.bytes_b), pair.same
    named = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    carried = cut(named.withColumn("uid", F.monotonically_increasing_id()), "align-texts")
    table = cut(_aligned(carried, path_a, path_b), "aligned")

    same_ids = [(a, int(a * size_b + b)) for a, b in enumerate(same.tolist()) if b >= 0]
    as_pair = spark.createDataFrame(same_ids, "a long, pair long")  # one row per id of A at most
    ones = _exploded(table, "same", "a").groupBy("a").agg(F.sum("n").alias("n"))
    ones = ones.join(F.broadcast(as_pair), "a").select("pair", "n")
    totals = _exploded(table, "pairs", "pair").unionByName(ones).groupBy("pair").agg(F.sum("n").alias("links"))
    totals = cut(totals.withColumn("b", F.col("pair") % size_b), "pair-counts")
    highest = totals.groupBy("b").agg(F.max("links").alias("highest"))  # one row per id of B at most
    totals = cut(
        totals.join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("highest")).alias("best")),
        "best-pairs",
    )
    everything = totals.agg(F.sum("links")).first()[0] or 0
    frequent = totals.where(F.col("links") >= -(-everything // known))
    of_same = totals.join(F.broadcast(as_pair.select("pair", "a")), "pair")

    def held(rows: DataFrame, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = rows.select(by, "links", "best").toArrow().sort_by(by)
        return tuple(got.column(i).to_numpy() for i in range(3))

    shared = spark.sparkContext.broadcast((held(of_same, "a"), held(frequent, "pair"), len(same)))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, ids_links, ids_best), (keys, links, best), size = shared.value
        links_of, best_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        links_of[ids], best_of[ids] = ids_links, ids_best
        for batch in batches:
            n = batch.num_rows
            columns = [batch.column(i) for i in range(1, 5)]
            (a, a_n), (b, b_n) = [[x.flatten().to_numpy() for x in columns[i : i + 2]] for i in (0, 2)]
            owner_a, owner_b = [np.repeat(np.arange(n), np.diff(columns[i].offsets.to_numpy())) for i in (0, 2)]
            at = np.minimum(np.searchsorted(keys, b), max(len(keys) - 1, 0))
            there = keys[at] == b if len(keys) else np.zeros(len(b), bool)
            hit, n_best, total = at[there], np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, owner_a, a_n * best_of[a])
            np.add.at(total, owner_a, a_n * links_of[a])
            if len(hit):
                np.add.at(n_best, owner_b[there], b_n[there] * best[hit])
                np.add.at(total, owner_b[there], b_n[there] * links[hit])
            rare = [_lists(owner_b[~there], x[~there], n, pa.int64()) for x in (b, b_n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_best), pa.array(total), *rare], ["uid", "n_best", "count_sum", "rare", "rare_n"]
            )

    schema = "uid long, n_best long, count_sum long, rare array<long>, rare_n array<long>"
    docs = table.where(F.col("kind") == _DOC)
    judged = cut(docs.select("uid", "same", "same_n", "pairs", "pairs_n").mapInArrow(judge, schema), "judged")
    rare = judged.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    rare = rare.select("uid", F.col("x.rare").alias("pair"), F.col("x.rare_n").alias("n")).join(totals, "pair")
    more = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum")
    )

    def plus(one: str, two: str) -> F.Column:
        return (F.col(one) + F.coalesce(two, F.lit(0))).alias(one)

    scores = judged.select("uid", "n_best", "count_sum").join(more, "uid", "left")
    numbers = docs.select("uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, "uid")
    out = carried.select("uid", key).join(numbers, "uid")
    out = out.select(
        key, "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"
    )
    by_id = totals.select((F.col("pair") / size_b).cast("long").alias("a"), (F.col("pair") % size_b).alias("b"), "links", "best")
    return out, by_id
