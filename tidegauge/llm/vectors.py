"""Near-duplicate vectors with an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codewords is a cell of the product grid.
Every vector stands in its nearest cell. To find its partners a vector visits the cells in order of
their distance (the multi-sequence order: the sum of the two halves' distances), as many as a target
recall needs, and all vectors met are verified by cosine in double precision. A pair in different cells
is looked for from the larger cell to the smaller one only, so it is met once.

How many cells to visit is measured when the codebooks are fitted: vectors of the sample are turned to
exactly the threshold, the worst case of a link, and the order of the cell they land in is recorded.

Bounds: the codebooks and that count are fitted on about ``sample`` vectors; all vectors are indexed.
Equal vectors are indexed once, with their number. A cell's members are split by a hash into parts of
about ``block`` vectors, and so are its visitors; a task compares one part with another (or with itself),
so it holds two parts at most, however many vectors a cell has.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link. Rows are kept one for one. Rows with a null id have no links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import sample_by_hash
from tidegauge.llm.components import components, roots
from tidegauge.session import cut


#: Rows of a part that are multiplied at a time.
STEP = 1_024


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.95
    recall: float = 0.98
    sample: int = 20_000
    #: Vectors per cell that the number of codewords aims at.
    per_cell: int = 8
    most_codewords: int = 512
    block: int = 2_048
    seed: int = 5


@dataclass
class Grid:
    """Two codebooks and the number of cells to visit."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squared(unit[:, :half], self.left), _squared(unit[:, half:], self.right)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell and the visited cells of each vector, nearest first."""
        a, b = self.distances(unit)
        order_a, order_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        # the first n cells of the order all have (i + 1) (j + 1) <= n, by rank in either half
        n, k = self.visits, a.shape[1]
        steps = np.array([(i, j) for i in range(min(n, k)) for j in range(min(n // (i + 1), k))])
        sums = np.take_along_axis(a, order_a, 1)[:, steps[:, 0]] + np.take_along_axis(b, order_b, 1)[:, steps[:, 1]]
        nearest = np.argsort(sums, 1, kind="stable")[:, :n]
        cells = order_a[np.arange(len(unit))[:, None], steps[nearest, 0]] * k + order_b[np.arange(len(unit))[:, None], steps[nearest, 1]]
        return cells[:, 0].astype(np.int64), cells.astype(np.int64)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:size]].copy()
    for _ in range(10):
        owner = _squared(x, centres).argmin(1)
        count = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit_grid(unit: np.ndarray, count: int, settings: Settings) -> Grid:
    """Codebooks for ``count`` vectors, from the unit vectors of a sample."""
    rng = np.random.default_rng(settings.seed)
    size = max(1, round((count / settings.per_cell) ** 0.5))
    size = int(min(size, settings.most_codewords, max(1, len(unit) // 8)))
    half = (unit.shape[1] + 1) // 2
    left, right = _codebook(unit[:, :half], size, rng), _codebook(unit[:, half:], size, rng)
    grid = Grid(left, right, 1)
    probe = unit[rng.permutation(len(unit))[:1000]]
    noise = rng.normal(size=probe.shape)
    noise -= (noise * probe).sum(1)[:, None] * probe
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    turned = settings.cosine * probe + np.sqrt(1 - settings.cosine**2) * noise / np.maximum(length, 1e-12)
    a, b = grid.distances(probe)
    to_a, to_b = (x.argmin(1) for x in grid.distances(turned))
    order = [
        np.count_nonzero(a[i][:, None] + b[i][None, :] < a[i][to_a[i]] + b[i][to_b[i]]) + 1 for i in range(len(probe))
    ]
    grid.visits = int(min(size * size, np.ceil(np.quantile(order, settings.recall)) + 1))
    return grid


def _unit(batch: pa.RecordBatch | pa.Table, column: str, width: int) -> np.ndarray:
    flat = batch.column(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(df: DataFrame, vector: str = "embedding", key: str = "vec_id", settings: Settings | None = None) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` for every row of ``df``."""
    settings = settings or Settings()
    component = F.col(vector)
    finite = F.forall(component, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.col(key).isNotNull() & (F.size(component) > 0) & finite & F.exists(component, lambda x: x != 0)
    marks = [F.xxhash64(component), F.xxhash64(F.lit(11), component)]
    rows = df.select(
        F.col(key).cast("long").alias("id"), component.cast("array<double>").alias("v"),
        F.coalesce(sound, F.lit(False)).alias("sound"), marks[0].alias("m0"), marks[1].alias("m1"),
    )
    # equal vectors once; the hashes of two seeds (128 bits) stand for the vector
    distinct = rows.where("sound").groupBy("m0", "m1").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    distinct = cut(distinct, "vectors")
    widths = {r["w"]: r["n"] for r in distinct.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = [_links(distinct.where(F.size("v") == w), w, n, settings) for w, n in sorted(widths.items())]
    if found:
        linked = found[0]
        for other in found[1:]:
            linked = linked.unionByName(other)
        linked = cut(linked, "links")
        roots = components(linked, "id", "root")
        sums = linked.groupBy("id").agg(F.sum("links").alias("links"))
        per = distinct.select("id", "m0", "m1", "n").join(sums, "id", "left").join(roots, "id", "left")
        per = per.select(
            "m0", "m1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("root", "id").alias("root"), F.lit(True).alias("sound"),
        )
        rows = rows.join(per, ["m0", "m1", "sound"], "left")
    else:
        rows = rows.withColumns({"links": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    root = F.coalesce("root", "id")
    return rows.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"),
    )


def _links(vectors: DataFrame, width: int, count: int, settings: Settings) -> DataFrame:
    """``id``, ``links`` (other vectors linked, copies counted) and ``root`` in parts; more than one row per id."""
    sample = sample_by_hash(vectors, "id", settings.sample).select("id", "v").toPandas().sort_values("id")
    x = np.array(sample["v"].tolist(), np.float64).reshape(-1, width)
    x /= np.abs(x).max(1, keepdims=True)
    grid = fit_grid(x / np.linalg.norm(x, axis=1, keepdims=True), count, settings)
    shared = vectors.sparkSession.sparkContext.broadcast(grid)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                own, visited = shared.value.cells(_unit(batch, "v", width))
                below = [row[row < cell] for row, cell in zip(visited, own, strict=True)]
                columns = [batch.column("id"), batch.column("n"), batch.column("v"), pa.array(own)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(below, pa.list_(pa.int64()))], ["id", "n", "v", "cell", "visits"])

    placed = vectors.select("id", "n", "v").mapInArrow(place, "id long, n long, v array<double>, cell long, visits array<long>")
    placed = cut(placed, "cells")
    guests = placed.select(F.explode("visits").alias("cell"), "id", "n", "v")
    members = placed.select("cell", "id", "n", "v")
    met = _dealt(members, guests, settings.block)

    def meet(table: pa.Table) -> pa.Table:
        alone = table.column("alone")[0].as_py()  # a part with itself
        table = table.sort_by([("member", "descending"), ("id", "ascending")])
        unit, ids = _unit(table, "v", width), table.column("id").to_numpy()
        n = table.column("n").to_numpy()
        count_ = int(np.count_nonzero(table.column("member").to_numpy(zero_copy_only=False)))
        links, out = np.zeros(len(ids), np.int64), []
        first = 0 if alone else count_
        for start in range(first, len(ids), STEP):
            stop = min(len(ids), start + STEP)
            close = unit[start:stop] @ unit[:count_].T >= settings.cosine
            if alone:
                close &= np.arange(start, stop)[:, None] > np.arange(count_)
            one, two = np.nonzero(close)
            if not len(one):
                continue
            one = one + start
            np.add.at(links, one, n[two])
            np.add.at(links, two, n[one])
            touched = np.unique(np.r_[one, two])
            root = roots(np.searchsorted(touched, one), np.searchsorted(touched, two), ids[touched])
            out.append((ids[touched], root))
        at = np.flatnonzero(links)
        tied = [np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in (0, 1)]
        return pa.table(
            {
                "id": np.r_[ids[at], tied[0]],
                "links": np.r_[links[at], np.zeros(len(tied[0]), np.int64)],
                "root": np.r_[ids[at], tied[1]],
            }
        )

    return met.groupBy("cell", "part", "with", "alone").applyInArrow(meet, "id long, links long, root long")


def _dealt(members: DataFrame, guests: DataFrame, block: int) -> DataFrame:
    """Rows (``cell``, ``part``, ``with``, ``alone``, ``member``, ``id``, ``n``, ``v``) whose first four name a task.

    Member parts meet themselves (``alone``) and each other, and every visitor part meets every member part.
    """
    number = F.ceil(F.count(F.lit(1)) / block).cast("int")
    held = members.groupBy("cell").agg(number.alias("parts"))
    # a visit to a cell where nobody stands meets nothing
    come = guests.select("cell").groupBy("cell").agg(number.alias("groups"))
    cells = cut(held.join(come, "cell", "left").select("cell", "parts", F.coalesce("groups", F.lit(0)).alias("groups")), "cell-sizes")
    row = ["id", "n", "v"]
    members = members.join(cells, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # of two parts the lower one's vectors are the members, the other's the guests
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    among = members.select("cell", "own", *row, other)
    among = among.select(
        "cell", F.least("own", "other").alias("part"), F.greatest("own", "other").alias("with"),
        (F.col("own") == F.col("other")).alias("alone"), (F.col("own") <= F.col("other")).alias("member"), *row,
    )
    # visitor groups are numbered behind the parts
    group = F.explode(F.sequence(F.col("parts"), F.col("parts") + F.col("groups") - 1)).alias("with")
    hosts = members.where("groups > 0").select("cell", F.col("own").alias("part"), group, F.lit(False).alias("alone"), F.lit(True).alias("member"), *row)
    guests = guests.join(cells, "cell")
    group = (F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")) + F.col("parts")).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    guests = guests.select("cell", part, group.alias("with"), F.lit(False).alias("alone"), F.lit(False).alias("member"), *row)
    return among.unionByName(hosts).unionByName(guests)
