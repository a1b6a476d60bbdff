"""Connected components of links by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import dropped, written


class Classes:
    """Smallest place reachable, by links that come in parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            apart = lo != hi
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, hi[apart], lo[apart])
            while (root[root] != root).any():
                root = root[root]
        self.root = root


def _stars(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """One star round, written. edges(u, v): u > v. Only each node's smallest neighbour is gathered, so a hub costs one row.

    The smallest neighbours are a table of their own: both sides of the join are then dealt anew, and Spark splits a hub.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
    met = both.join(least.hint("merge"), "u")
    if large:
        made = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(made.where("u > v").distinct(), label)
    dropped(least)
    return out


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """node, component for every node with a link; component is the smallest node reachable. edges: u, v long, any order.

    Empty input gives no rows. Each round is written to the shared folder, so lineage stays short.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark, wide = None, "decimal(38,0)"  # sums of node numbers may pass 64 bits
    while True:
        grown = _stars(now, True, label)
        after = _stars(grown, False, label)
        dropped(now)
        dropped(grown)
        # the smallest stars change no more: same rows, same sum of both ends
        fresh = tuple(after.agg(F.count(F.lit(1)), F.sum(F.col("u").cast(wide)), F.sum(F.col("v").cast(wide)), F.sum(F.xxhash64("u", "v").cast(wide))).first())
        now = after
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
