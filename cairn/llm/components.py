"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two group-minimum aggregations and joins, so a component's size bounds neither a
task's memory nor the driver's. A local union-find in every partition shortens long chains
before the first round. The edge table of each round is written to the shared folder. As soon as
no more than FINISH_EDGES edges are left, a few megabytes, one task ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


FINISH_EDGES = 100_000


class UnionFind:
    """Disjoint sets over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges a-b, as edges from each node to its component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        sets.join(x, y)
    root = sets.roots()
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_a, held_b, n = [], [], 0

    def emit() -> pa.RecordBatch:
        x, y = stars(np.concatenate(held_a), np.concatenate(held_b))
        held_a.clear()
        held_b.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for batch in batches:
        held_a.append(batch.column(0).to_numpy())
        held_b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= 500_000:
            yield emit()
            n = 0
    if held_a:
        yield emit()


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One half round over edges a > b: every node's neighbours move to its least neighbour.

    The least neighbours are written first: where both sides of the join are read from tables,
    Spark can split the neighbours of a hot node over many tasks.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.save(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
    moved = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, contracted: bool = False) -> DataFrame:
    """``node`` and ``root`` (the component's least node) of every node on an edge ``a``-``b``.

    Both columns are non-null longs; self-loops and repeated edges do no harm. Nodes that are
    roots themselves are included. An empty table gives an empty result. ``contracted``: the
    edges are stars already, so a local union-find (and a second Python worker) would gain nothing.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    first = edges.select("a", "b").where(F.col("a") != F.col("b"))
    if contracted:
        first = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        first = first.mapInArrow(_contract, "a long, b long")
    now = scratch.save(first.distinct())
    before = state(now)
    if 0 < before[0] <= FINISH_EDGES:
        now = scratch.save(now.coalesce(1).mapInArrow(_contract, "a long, b long"))
    elif before[0]:
        while True:
            first_table = scratch.n - 1
            half = scratch.save(_star(now, True, scratch))
            now = scratch.save(_star(half, False, scratch))
            after = state(now)
            for number in range(first_table, scratch.n - 1):
                scratch.drop(number)
            scratch.free()
            if after == before:
                break
            if after[0] <= FINISH_EDGES:
                now = scratch.save(now.coalesce(1).mapInArrow(_contract, "a long, b long"))
                break
            before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
