"""Passages that stand more than once in a corpus, found by fixed-block anchors, and texts without them.

A window is ``window`` consecutive words of one document. Each document is cut into blocks of
``(window + 1) // 2`` words from its start, so that every window holds a whole block.

1. *Index and probe.* The blocks are indexed by hash, and every rolling stretch of a block's length, at
   any offset of any document, is looked up in the index. A block that two stretches meet is an anchor.
2. *Extend.* Around each anchor the windows that hold it are compared by a 96-bit hash of all their words.
   Those that start anywhere else, the same document included, repeat; neighbouring ones join to maximal
   repeats. A block met by chance is an anchor too many, which costs a comparison and changes no result.

Both steps deal hashes out by value, in packed rows: one per bucket and chunk (a few megabytes of text).
What a chunk holds twice it settles by itself and tells the bucket once, so a passage of a third of all
texts puts one entry per chunk into a bucket, not one per text. Buckets hold about a million hashes each; what is
sent of a stretch are the 32 bits of its hash below those of the bucket.

Words are stretches of anything but ASCII white space, compared as they are. Null texts have no words;
texts with fewer words than a window lose none. Keys may be null or repeated: every row is a document,
so both rows of a repeated one lose their windows. No document and no window is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import spread
from tidegauge.llm.common import hand_back, pieces
from tidegauge.session import cut

WINDOW = 35
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Hashes in a bucket, about.
BUCKET = 1_000_000
#: Words whose hashes a worker remembers.
WORD_LIMIT = 250_000
_STEP = np.uint64(0x5851F42D4C957F2D)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Two hashes per word, kept in a bounded table, and hashes of stretches of words."""

    def __init__(self, limit: int = WORD_LIMIT):
        self.limit = limit
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self._index: defaultdict[bytes, int] = defaultdict()
        self._index.default_factory = self._index.__len__
        self._hashes = np.empty((2, 0), np.uint64)

    def hashes(self, texts: list[list[bytes]]) -> np.ndarray:
        """The two hashes of each word of all texts, one text after the other."""
        if len(self._index) > self.limit:
            self._clear()
        at = [np.fromiter(map(self._index.__getitem__, x), np.int64, len(x)) for x in texts]
        known = self._hashes.shape[1]
        if len(self._index) > known:
            fresh = list(self._index)[known:]
            new = [[xxhash.xxh3_64_intdigest(x, seed) for x in fresh] for seed in (1, 2)]
            self._hashes = np.concatenate([self._hashes, np.array(new, np.uint64)], axis=1)
        return self._hashes[:, np.concatenate(at) if at else np.empty(0, np.int64)]

    def stretches(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """A hash of the ``length`` words from each position on; positions without so many have none."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        if len(self.powers) < n:
            back = pow(int(_STEP), -1, 1 << 64)
            self.powers = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, _STEP)])
            self.inverse = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, back, np.uint64)])
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:n])]
        return _mixed((sums[length:] - sums[:-length]) * self.inverse[: n - length + 1])


@lru_cache(maxsize=1)
def words() -> Words:
    """One table per worker process."""
    return Words()


def _split(batch: pa.RecordBatch, column: str) -> list[list[bytes]]:
    """Words of each text; ``bytes.split`` parts at ASCII white space only."""
    return [(x or b"").split() for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash by its upper bits; ``buckets`` is a power of two, sorted hashes have sorted buckets."""
    return (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def _below(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits below those of the bucket."""
    return (hashes >> np.uint64(32 - buckets.bit_length() + 1)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: high bytes are mostly zero, and pack well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _parts(at: np.ndarray, buckets: int, *columns: np.ndarray) -> list[list[bytes]]:
    """Each column's bytes by bucket, in planes; ``at`` is sorted."""
    ends = np.searchsorted(at, np.arange(buckets + 1))
    cuts = list(zip(ends[:-1], ends[1:], strict=True))
    return [[_planes(x[a:b]) for a, b in cuts] for x in columns]


def _steps(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sorted numbers as steps from the one before in the same bucket."""
    steps = np.diff(values, prepend=values[:1])
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.empty(0, bool)
    steps[new] = values[new]
    return steps


def _joined(table: pa.Table, column: str, kind: type, steps: bool = False) -> np.ndarray:
    """The numbers of all rows, one row after the other."""
    parts = [_unplaned(x.as_buffer(), kind) for x in table.column(column)]
    if steps:
        parts = [np.cumsum(x, dtype=kind) for x in parts]
    return np.concatenate(parts) if parts else np.empty(0, kind)


_PROBES = "bucket int, once binary, more binary, key binary, uid binary, block binary"
_ANSWERS = "bucket int, uid binary, start binary"
_EDGES = "bucket int, hash binary, tail binary, uid binary, start binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(schema: str, columns: list[list[bytes]]) -> pa.RecordBatch:
    """Rows with what they hold for each bucket; empty ones are left out."""
    filled = [i for i, row in enumerate(zip(*columns, strict=True)) if any(row)]
    arrays = [pa.array(filled, pa.int32())]
    arrays += [pa.array([x[i] for i in filled], pa.binary()) for x in columns]
    return pa.RecordBatch.from_arrays(arrays, _names(schema))


def _settled(schema: str, bucket: int, **known: np.ndarray) -> pa.RecordBatch:
    """A row that passes an answer on."""
    arrays = [pa.array([bucket], pa.int32())]
    arrays += [pa.array([_planes(known[x]) if x in known else b""], pa.binary()) for x in _names(schema)[1:]]
    return pa.RecordBatch.from_arrays(arrays, _names(schema))


def anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """``uid`` and ``block`` (its number) of the blocks that stand elsewhere too; docs have uid and __text."""
    size = (window + 1) // 2

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, turn = words(), 0
        for batch in batches:
            for part in pieces(batch, "__text", CHUNK_BYTES):
                texts = _split(part, "__text")
                uids = part.column("uid").to_numpy()
                longer = [i for i, x in enumerate(texts) if len(x) >= window]
                if not longer:
                    continue
                counts = np.array([len(texts[i]) for i in longer])
                rolling = table.stretches(table.hashes([texts[i] for i in longer])[0], size)
                starts = np.cumsum(counts) - counts
                inside = spread(starts, counts - size + 1)  # stretches within one document
                found, first, inverse, n = np.unique(
                    rolling[inside], return_index=True, return_inverse=True, return_counts=True
                )
                full = counts // size
                number = spread(np.zeros(len(full), np.int64), full)
                owner = np.repeat(np.arange(len(full)), full)
                gaps = np.cumsum(counts - size + 1) - (counts - size + 1)
                at = inverse[gaps[owner] + number * size]  # each block among the distinct stretches
                uid, number = uids[np.array(longer)[owner]], number.astype(np.int32)
                twice = n[at] > 1
                if twice.any():
                    turn += 1
                    yield _settled(_PROBES, int(uids[0] + turn) % buckets, uid=uid[twice], block=number[twice])
                order = np.argsort(at[~twice], kind="stable")
                single, uid, number = at[~twice][order], uid[~twice][order], number[~twice][order]
                of, short = _bucket(found, buckets), _below(found, buckets)
                columns = [_parts(of[x], buckets, _steps(of[x], short[x]))[0] for x in (n == 1, n > 1, single)]
                columns += _parts(of[single], buckets, uid, number)
                yield _rows(_PROBES, columns)
            hand_back()

    def meet(rows: pa.Table) -> pa.Table:
        asked = pc.greater(pc.binary_length(rows.column("key")), 0)
        kept, passed = rows.filter(asked), rows.filter(pc.invert(asked))
        keys = _joined(kept, "key", np.uint32, steps=True)
        index = np.unique(keys)
        seen = np.zeros(len(index) + 1, np.int64)
        for column, weight in (("once", 1), ("more", 2)):
            stretch = _joined(rows, column, np.uint32, steps=True)
            at = np.searchsorted(index, stretch)
            met = (at < len(index)) & (np.r_[index, np.uint32(0)][at] == stretch)
            seen += weight * np.bincount(at[met], minlength=len(seen))
        hit = seen[np.searchsorted(index, keys)] > 1
        uid = np.r_[_joined(kept, "uid", np.int64)[hit], _joined(passed, "uid", np.int64)]
        block = np.r_[_joined(kept, "block", np.int32)[hit], _joined(passed, "block", np.int32)]
        return pa.table({"uid": uid, "block": block.astype(np.int32)})

    return docs.select("uid", "__text").mapInArrow(probe, _PROBES).groupBy("bucket").applyInArrow(meet, "uid long, block int")


def repeated(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """``uid`` and ``starts``: where windows start whose words start elsewhere too, in no order.

    Answers go home by groups of documents, packed like the questions: a row per bucket and group.
    """
    groups = max(buckets // 8, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = (window + 1) // 2
    found = anchors(docs, window, buckets).groupBy("uid").agg(F.collect_list("block").alias("blocks"))
    around = docs.join(found, "uid")

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, turn = words(), 0
        for batch in batches:
            for part in pieces(batch, "__text", CHUNK_BYTES):
                texts = _split(part, "__text")
                counts = np.array([len(x) for x in texts])
                both = table.hashes(texts)
                one, two = (table.stretches(x, window) for x in both)
                blocks = part.column("blocks")
                owner = np.repeat(np.arange(len(texts)), np.diff(blocks.offsets.to_numpy()))
                begin = blocks.flatten().to_numpy().astype(np.int64) * size
                low, high = np.maximum(begin - (window - size), 0), np.minimum(begin, counts[owner] - window)
                owner = np.repeat(owner, high - low + 1)
                starts = np.cumsum(counts) - counts
                places = np.unique(starts[owner] + spread(low, high - low + 1))  # positions in the chunk
                owner = np.searchsorted(starts + counts, places, side="right")
                uid, start = part.column("uid").to_numpy()[owner], (places - starts[owner]).astype(np.int32)
                a, b = one[places], two[places].astype(np.uint32)
                order = np.lexsort((b, a))
                a, b, uid, start = a[order], b[order], uid[order], start[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                last = np.r_[new[1:], True]
                alone = new & last
                if not alone.all():
                    turn += 1
                    yield _settled(_EDGES, int(uid[0] + turn) % buckets, uid=uid[~alone], start=start[~alone])
                uid = np.where(alone, uid, -1)
                sent = [x[new] for x in (a, b, uid, start)]
                yield _rows(_EDGES, _parts(_bucket(sent[0], buckets), buckets, *sent))
            hand_back()

    def meet(rows: pa.Table) -> pa.Table:
        asked = pc.greater(pc.binary_length(rows.column("hash")), 0)
        kept, passed = rows.filter(asked), rows.filter(pc.invert(asked))
        a, b = _joined(kept, "hash", np.uint64), _joined(kept, "tail", np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        uid, start = _joined(kept, "uid", np.int64)[order], _joined(kept, "start", np.int32)[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = (np.r_[False, same] | np.r_[same, False])[: len(a)] & (uid >= 0)
        uid = np.r_[uid[twice], _joined(passed, "uid", np.int64)]
        start = np.r_[start[twice], _joined(passed, "start", np.int32)].astype(np.int32)
        group = (_mixed(uid.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        return pa.Table.from_batches([_rows(_ANSWERS, _parts(group[order], groups, uid[order], start[order]))])

    def gather(rows: pa.Table) -> pa.Table:
        uid, start = _joined(rows, "uid", np.int64), _joined(rows, "start", np.int32)
        order = np.argsort(uid, kind="stable")
        uid, first = np.unique(uid[order], return_index=True)
        offsets = np.r_[first, len(order)].astype(np.int32)
        return pa.table({"uid": uid, "starts": pa.ListArray.from_arrays(offsets, pa.array(start[order]))})

    # whole rows go in, so that this join reads the exchange that the last one needs
    answers = around.mapInArrow(edges, _EDGES).groupBy("bucket").applyInArrow(meet, _ANSWERS)
    return answers.groupBy("bucket").applyInArrow(gather, "uid long, starts array<int>")


def without_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, bucket: int = BUCKET
) -> DataFrame:
    """Per row ``key``, ``n_words``, ``n_removed``, ``kept`` (its other words, joined by one blank) and
    ``spans``: first word and end of each maximal stretch that repeats."""
    spark = df.sparkSession
    named = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    docs = cut(named.withColumn("uid", F.monotonically_increasing_id()), "repeat-texts", "zstd")
    docs = docs.where("uid is not null")  # so that both joins below read one and the same exchange
    total = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = max(int(total / 5 / bucket), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 1 << min((buckets - 1).bit_length(), 24)
    found = docs.join(repeated(docs, window, buckets), "uid", "left").select("__key", "__text", "starts")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", CHUNK_BYTES):
                numbers, kept, spans = [], [], []
                for tokens, starts in zip(_split(part, "__text"), part.column("starts"), strict=True):
                    if not starts.is_valid:
                        numbers.append((len(tokens), 0))
                        kept.append(b" ".join(tokens))
                        spans.append([])
                        continue
                    at = np.unique(starts.values.to_numpy())
                    edge = np.flatnonzero(np.diff(at) > window)
                    begins, ends = at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]] + window
                    left = np.r_[0, ends], np.r_[begins, len(tokens)]
                    stay = [b" ".join(tokens[a:b]) for a, b in zip(*left, strict=True) if a < b]
                    numbers.append((len(tokens), int((ends - begins).sum())))
                    kept.append(b" ".join(stay))
                    spans.append([{"first": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
                n = np.array(numbers, np.int64).reshape(-1, 2)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                arrays = [part.column(0), pa.array(n[:, 0]), pa.array(n[:, 1])]
                arrays += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["__key", "n_words", "n_removed", "kept", "spans"])

    spans = F.lit(None).cast("array<struct<first:bigint,end:bigint>>").alias("spans")
    schema = named.select("__key", *[F.lit(0).cast("long").alias(x) for x in ("n_words", "n_removed")], F.lit("").alias("kept"), spans).schema
    return found.mapInArrow(drop, schema).withColumnRenamed("__key", key)
