"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; arrays of some ten times that size stand on them.
SLICE_BYTES = 1 << 20
#: The same for encoding, which needs less room and gains from more fragments at a time.
ENCODE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of at most ``limit`` bytes in ``column``, or of one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def sliced(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, column)
        hand_back()
    hand_back()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Fewer rows per Arrow batch from now on, unless the session names its own number.

    Rows here are whole texts: ten thousand of them are tens of megabytes, held by each worker, and by
    each task beside the heap.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(rows))


def hand_back() -> None:
    """Give freed memory back to the system: workers live on from stage to stage beside a full heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Strings of a column, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def hash_below(key: Column, share: Column | float, seed: int) -> Column:
    """True for a share of the keys, chosen by a hash: the same ones in any partitioning."""
    unit = F.xxhash64(key, F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)
    return unit < share


def sample_by_hash(df: DataFrame, key: str, size: int, by: str | None = None, seed: int = 17) -> DataFrame:
    """About ``size`` rows (of each value of ``by``), chosen by a hash of their key; no shuffle of rows.

    The number varies around ``size`` as a binomial count does. Only the row counts come to the driver.
    """
    if by is None:
        count = df.count()
        return df if count <= size else df.where(hash_below(F.col(key), size / count, seed))
    counts = {row[by]: row["count"] for row in df.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, size / count) + (count <= size))).otherwise(share)
    return df.where(hash_below(F.col(key), share, seed))
