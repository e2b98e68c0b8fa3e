"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest node of each node's component: node, component. Nodes without an edge to another are left out.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of them, so components turn into
    stars in a number of rounds that is logarithmic in their width; neighbours are never gathered, only their minimum
    is. A round is written to the shared folder, so lost executors don't undo it.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("w"))
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialise(small.where("u != v").distinct())
        if not _differ(now, after):
            break
        now = after
    stars = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(after.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _differ(x: DataFrame, y: DataFrame) -> bool:
    sign = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003), F.bit_xor(F.xxhash64("u", "v"))).first()
    return sign(x) != sign(y)


def union_find(n: int) -> tuple:
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def union(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
        return i != j

    def roots() -> np.ndarray:
        root = parent[parent]
        while True:
            up = root[root]
            if (up == root).all():
                return root
            root = up

    return find, union, roots
