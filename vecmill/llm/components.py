"""Connected components of an edge table: union-find within partitions, then stars.

Rounds of large-star and small-star (Kiveris et al., "Connected components in MapReduce
and beyond") end when the edges don't change. Each round is a written table, so a lost
executor repeats part of one round only. A node of many edges is aggregated before it is
shuffled, and its join is split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

EDGES = "u long, v long"


class UnionFind:
    """Union by smaller id with path halving."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        if x not in p:
            p[x] = x
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def contract(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars around the smallest node, found by union-find,
    200,000 edges at a time."""

    def run(batches):
        def stars(sets):
            rows = [(x, sets.find(x)) for x in list(sets.parent)]
            u, v = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        sets, n = UnionFind(), 0
        for b in batches:
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist()):
                sets.union(u, v)
            n += b.num_rows
            if n > 200_000:
                yield stars(sets)
                sets, n = UnionFind(), 0
        if n:
            yield stars(sets)

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(run, EDGES)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct. Each node's neighbours (large: the greater ones; small: the smaller
    ones and itself) are tied to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    near = both.join(least, "u")
    if large:
        near = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return near.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node that has an edge to another.
    Nulls, loops and repeated edges make no difference; no edges give no rows."""
    edges = written(contract(edges.where("u is not null and v is not null")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = written(_star(_star(edges, True), False), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
