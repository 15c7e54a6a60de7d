"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node ``a`` the smallest of itself and its neighbours ``b``."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge: ``node``, ``root``; edges are (a, b) of long ids.

    Each round links every node to the smallest node it sees, first for larger then for smaller neighbours, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain. Rounds are stored tables, nodes with many
    neighbours are grouped by partial minima and split by skewed joins, and only two sums per round reach the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_smallest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(_smallest(large), "a")
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stored(linked.where("a <> b").distinct())


def spanning_links(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a star per component over the nodes 0 to n - 1: at most n links with the same components as a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]
