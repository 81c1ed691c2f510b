"""Token ids in word-aligned binary files (Simple-8b).

A 64-bit word is a selector of four bits and sixty bits of payload; the selector says how many ids of
how many bits the word packs. Ids stand in blocks of ``BLOCK``; each block starts a new word, and the
word count of every block is stored, so that blocks decode independently and all words of one
selector decode in one vector operation. Values that need more than sixty bits are kept aside: the
escape selector stores their index there.

A file is Parquet, so that Spark's own writer and committer handle lost tasks. One row holds a stretch
of consecutive documents: their ids and token counts, the words, the words per block, the values
aside, and how many ids precede the stretch in its shard. Shards are ranges of the document id in
ascending order. Null texts are empty documents; a null id sorts first; rows of one id are ordered by
text and stay separate. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpe import encoder, little_endian
from tidegauge.llm.common import ENCODE_BYTES, pieces, texts_of

BLOCK = 1024
# Ids per word and bits per id of the selectors 0 to 14; selector 15 is the escape.
COUNTS = (120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
_PAYLOAD = np.uint64((1 << 60) - 1)
_COUNT_OF = np.array([*COUNTS, 1], np.int64)
_SELECTOR_OF = np.full(max(COUNTS) + 1, ESCAPE, np.uint8)
_SELECTOR_OF[list(COUNTS)] = np.arange(len(COUNTS))


def _smallest(ids: np.ndarray) -> np.ndarray:
    """The smallest selector whose width holds each id."""
    limits = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
    return np.searchsorted(limits, ids).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words per block, and values aside, for unsigned ids of any size."""
    ids = ids.astype(np.uint64)
    total, blocks = len(ids), -(-len(ids) // BLOCK)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint64)
    reach = max(COUNTS)
    need = np.zeros((blocks, BLOCK + reach), np.uint8)  # beyond the end of a block anything fits
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:total] = _smallest(ids)
    need[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    # takes[b, i]: ids that a word starting there holds; wider words hold fewer, so the last fit wins
    takes = np.ones((blocks, BLOCK), np.uint8)
    widest, span = need.copy(), 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        while span < COUNTS[selector]:
            step = min(span, COUNTS[selector] - span)
            widest[:, : reach + BLOCK - step] = np.maximum(widest[:, : reach + BLOCK - step], widest[:, step:])
            span += step
        fits = widest[:, :BLOCK] <= selector
        if not fits.any():
            break
        np.copyto(takes, COUNTS[selector], where=fits)
    # follow the words of all blocks in step
    last = np.full(blocks, BLOCK)
    last[-1] = total - (blocks - 1) * BLOCK
    takes, begins = takes.ravel(), np.zeros(blocks * BLOCK, bool)
    at, end = np.arange(blocks) * BLOCK, np.arange(blocks) * BLOCK + last
    while len(at):
        begins[at] = True
        at = at + takes[at]
        on = at < end
        if not on.all():
            at, end = at[on], end[on]
    start = np.flatnonzero(begins)
    size = takes[start].astype(np.int64)
    per_block = np.bincount(start // BLOCK, minlength=blocks).astype(np.int32)
    selector = _SELECTOR_OF[size].astype(np.uint64)
    selector[(size == 1) & (padded[start] > len(COUNTS) - 1)] = ESCAPE
    aside = ids[start[selector == ESCAPE]]
    words = selector << np.uint64(60)
    words[selector == ESCAPE] |= np.arange(len(aside), dtype=np.uint64)
    zeros = np.zeros(blocks * BLOCK + reach, np.uint64)
    zeros[:total] = ids
    block_end = (start // BLOCK + 1) * BLOCK
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(selector == s)
        if width == 0 or not len(rows):
            continue
        for k in range(count):
            here = start[rows] + k
            value = np.where(here < block_end[rows], zeros[here], np.uint64(0))
            words[rows] |= value << np.uint64(k * width)
    return words, per_block, aside


def unpack(words: np.ndarray, per_block: np.ndarray, aside: np.ndarray, total: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(per_block)), per_block)
    size = _COUNT_OF[selector]
    before = np.cumsum(size) - size
    first = np.cumsum(per_block) - per_block
    start = block * BLOCK + before - before[first][block] if len(words) else before
    out = np.zeros(len(per_block) * BLOCK + max(COUNTS), np.uint64)
    end = (block + 1) * BLOCK
    payload = words & _PAYLOAD
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(selector == s)
        if width == 0 or not len(rows):
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            here = start[rows] + k
            inside = here < end[rows]
            out[here[inside]] = (payload[rows[inside]] >> np.uint64(k * width)) & mask
    escaped = selector == ESCAPE
    out[start[escaped]] = aside[payload[escaped].astype(np.int64)]
    return out[:total]


FILE_SCHEMA = (
    "shard int, before long, n_ids long, keys array<long>, counts array<long>,"
    " words binary, block_words binary, aside binary"
)


def write(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts of ``df`` with the vocabulary at ``path`` and write them in order of ``key``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, "__text", ENCODE_BYTES):
                flat, lengths = coder.encode(texts_of(part, "__text"))
                flat = np.insert(flat, np.cumsum(lengths), np.uint32(end_id))
                words, per_block, aside = pack(flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.array([len(flat)], pa.int64()),
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([(lengths + 1).tolist()], pa.list_(pa.int64())),
                        pa.array([words.astype("<u8").tobytes()], pa.binary()),
                        pa.array([per_block.astype("<i4").tobytes()], pa.binary()),
                        pa.array([aside.astype("<u8").tobytes()], pa.binary()),
                    ],
                    ["shard", "before", "n_ids", "keys", "counts", "words", "block_words", "aside"],
                )
                before += len(flat)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"))
    ordered = rows.repartitionByRange("__key").sortWithinPartitions("__key", "__text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def _row_ids(row: dict) -> np.ndarray:
    return unpack(
        np.frombuffer(row["words"], "<u8"),
        np.frombuffer(row["block_words"], "<i4"),
        np.frombuffer(row["aside"], "<u8"),
        row["n_ids"],
    )


def shard_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each shard; one number per file part comes to the driver."""
    sums = spark.read.schema(FILE_SCHEMA).parquet(folder).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(sums, key=lambda r: r["shard"]):
        starts[row["shard"]] = total
        total += row["n"]
    return starts


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of the files: key, ``start`` (ids of all documents before it), ``ids``."""
    return _documents(spark, folder, key, [("ids", "array<int>")], lambda x: [x.astype(np.int32)])


def summary(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """As ``read``, with ``n_tokens`` and the CRC-32 of the ids in place of the ids."""
    out = [("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    return _documents(spark, folder, key, out, lambda x: [len(x), zlib.crc32(little_endian(x))])


def _documents(spark: SparkSession, folder: str, key: str, columns: list[tuple[str, str]], made) -> DataFrame:
    starts = shard_starts(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, counts = _row_ids(row), np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                found = [made(ids[end - n : end]) for end, n in zip(ends, counts, strict=True)]
                start = starts[row["shard"]] + row["before"] + ends - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["keys"], pa.int64()),
                        pa.array(start, pa.int64()),
                        *[pa.array([x[i] for x in found], kinds[kind]) for i, (_, kind) in enumerate(columns)],
                    ],
                    [key, "start", *[name for name, _ in columns]],
                )

    schema = ", ".join(f"`{name}` {kind}" for name, kind in [(key, "bigint"), ("start", "bigint"), *columns])
    return spark.read.schema(FILE_SCHEMA).parquet(folder).mapInArrow(run, schema)
