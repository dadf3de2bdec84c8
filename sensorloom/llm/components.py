"""Connected components without gathering any of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.session import settle

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` that is not the least of its component; ``root`` is the least.

    Large-star and small-star steps in turn: each links neighbours to the least node around, until nothing changes
    (a number of rounds logarithmic in the size of a component).  A node's neighbours are never collected; its
    least one comes from a grouped minimum.  Self-loops and repeated edges do no harm.
    """

    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.where("a <> b")
        if large:
            near = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_v"), F.least("a", "_m").alias("_m"))
        met = near.join(least, F.col("a") == F.col("_v"))
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("_v", "_m")).where("a <> b")
        return out.distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    for _ in range(ROUNDS):
        now = settle(starred(starred(now, True), False))
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of the nodes of one task after the pairs ``(a, b)`` joined their groups; a label is the least index of its group."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root = up
