"""Connected components of an edge table by alternating large and small stars.

No group of edges is ever held in one task: the smallest neighbour is an aggregate with map-side
combination, and it is joined back by node, where adaptive execution splits a hot node. Each turn is
written to the shared folder, so the plan stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every node that has an edge to another.

    Loops, repeated edges and edges with a null end are ignored.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = edges.where(F.col(a) != F.col(b)).select(high.cast("long").alias("id"), low.cast("long").alias("root")).distinct()
    now = cut(now, "stars")
    before = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            return now
        before = size
        now = cut(_small(_large(now)), "stars")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, or to the node."""
    both = edges.union(edges.select(F.col("root").alias("id"), F.col("id").alias("root")))
    least = both.groupBy("id").agg(F.least(F.min("root"), F.col("id")).alias("least"))
    larger = edges.select(F.col("root").alias("id"), F.col("id").alias("other"))
    return larger.join(least, "id").select(F.col("other").alias("id"), F.col("least").alias("root"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("id").agg(F.min("root").alias("least"))
    moved = edges.join(least, "id").select(F.col("root").alias("id"), F.col("least").alias("root"))
    tied = moved.union(least.select("id", F.col("least").alias("root")))
    return tied.where(F.col("id") != F.col("root")).distinct()


def roots(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each position reaches over the edges one-two, within a task."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, one, label[two])
        np.minimum.at(label, two, label[one])
        if (label == before).all():
            return label
