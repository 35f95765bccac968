"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import Scratch

MOST_ROUNDS = 60


def _to_least(undirected: DataFrame) -> DataFrame:
    """u, v, m: each edge with the least node in the neighbourhood of u, u included. A node with very many edges is one partial sum per task, and the join is one the planner can split."""
    least = undirected.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return undirected.join(least, "u")


def connected(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b) but the roots themselves.

    Each round links nodes to the least node they see: first larger neighbours, then smaller ones. Both keep components
    whole, and the edges become stars in a number of rounds that grows with the logarithm of the longest chain. Edges are
    written to the shared folder between rounds, and the driver sees a count and a checksum alone.
    """
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{label}-0")
    state = None
    for k in range(1, MOST_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        near = _to_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        done = scratch.cut(small, f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        now, seen = done, tuple(done.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
    raise RuntimeError("components did not settle")
