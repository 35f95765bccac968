"""Nearest neighbours and distance bands on grid bins: equi-joins on bins, exact distances after."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import settled


def _binned(df: DataFrame, size: float, prefix: str) -> DataFrame:
    """id, x, y, bx, by under a prefix."""
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "x", "y")), F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))


def _around(df: DataFrame, ring: int) -> DataFrame:
    """A row per bin within ``ring`` bins of the point's own."""
    return df.withColumn("bx", F.explode(F.sequence(F.col("bx") - ring, F.col("bx") + ring))).withColumn("by", F.explode(F.sequence(F.col("by") - ring, F.col("by") + ring)))


def distance(a: str = "q", b: str = "r"):
    dx, dy = F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y")
    return F.sqrt(dx * dx + dy * dy)


#: A bin and those after it: each two bins that touch meet once.
_AHEAD = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def within(queries: DataFrame, points: DataFrame, reach: float, self_join: bool = False) -> DataFrame:
    """q_id, r_id, d for all pairs at most ``reach`` apart. Bins have half that size, so a pair lies in bins at most two apart. In a self-join a point isn't its own partner; other points at the same place are.

    Where queries and points are the same frame, bins are as wide as the reach, each two points meet once, and both orders
    come of that: six rows a point are shuffled, not 26. The bins are dealt to a fixed number of tasks: the rows that are
    shuffled are few and their pairs many, so tasks merged by shuffled bytes would leave all pairs to a handful.
    """
    parts = 4 * max(queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = self_join and queries is points
    if once:
        ahead = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _AHEAD)))
        wide = reach * (1 + 1e-9)  # quotients are rounded
        near_by = _binned(queries, wide, "q").withColumn("_o", ahead).withColumns({"bx": F.col("bx") + F.col("_o.x"), "by": F.col("by") + F.col("_o.y"), "own": (F.col("_o.x") == 0) & (F.col("_o.y") == 0)}).drop("_o")
        held = _binned(points, wide, "r")
    else:
        near_by, held = _around(_binned(queries, reach / 2, "q"), 2), _binned(points, reach / 2, "r")
    out = near_by.repartition(parts, "bx", "by").hint("merge").join(held.repartition(parts, "bx", "by"), ["bx", "by"]).withColumn("d", distance()).where(F.col("d") <= reach)
    if once:
        both = F.array(*(F.struct(F.col(a).alias("q_id"), F.col(b).alias("r_id"), F.col("d").alias("d")) for a, b in (("q_id", "r_id"), ("r_id", "q_id"))))
        return out.where("IF(own, q_id < r_id, q_id != r_id)").select(F.inline(both))
    return (out.where("q_id != r_id") if self_join else out).select("q_id", "r_id", "d")


def bin_size(queries: DataFrame, points: DataFrame, k: int) -> tuple[float, float]:
    """A bin that holds about k points, and the extent of all: two aggregations, a row each to the driver."""
    bounds = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    n, *p = points.agg(F.count("*"), *bounds).first()
    q = queries.agg(*bounds).first()
    x0, x1, y0, y1 = (v if v is not None else 0.0 for v in p)
    both = [[v for v in (a, b) if v is not None] or [0.0] for a, b in zip(p, q)]
    extent = max(max(both[1]) - min(both[0]), max(both[3]) - min(both[2]), 1.0)
    return max(math.sqrt(max(x1 - x0, 1.0) * max(y1 - y0, 1.0) * (k + 1) / max(n, 1)), 1e-9), extent


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, self_join: bool = False, ties: bool = False, size: float | None = None) -> DataFrame:
    """q_id, r_id, d, nth: the k nearest points (ties by r_id); with ``ties`` all at the k-th distance stay.

    Points in the nine bins around a query are joined; the answer stands where the k-th distance is at most the bin's
    size, as nothing nearer can lie outside. The others, few with bins of about k points, are asked again with bins twice
    as large, so a query far from everything costs a handful of rounds and no round spreads a row over more than nine bins.
    Where points crowd in a bin, a tree takes over.
    """
    own, extent = bin_size(queries, points, k)
    size = size or own
    if fullest(points, size) > CROWDED * (k + 1):
        return nearest_by_tree(queries, points, k, self_join, ties)
    order = Window.partitionBy("q_id").orderBy("d", "r_id")
    rank = Window.partitionBy("q_id").orderBy("d")
    pending, out = queries.select("id", "x", "y"), None
    while True:
        pairs = _around(_binned(pending, size, "q"), 1).join(_binned(points, size, "r"), ["bx", "by"]).withColumn("d", distance())
        if self_join:
            pairs = pairs.where("q_id != r_id")
        found = pairs.select("q_id", "r_id", "d", F.row_number().over(order).alias("nth"), F.rank().over(rank).alias("place")).where(f"place <= {k}")
        last = size >= extent
        sure = found if last else found.withColumn("far", F.max(F.when(F.col("nth") == k, F.col("d"))).over(Window.partitionBy("q_id"))).where(F.col("far") <= size).drop("far")
        sure = settled(sure)
        out = sure if out is None else out.unionByName(sure)
        if last:
            break
        pending = settled(pending.join(sure.select(F.col("q_id").alias("id")).distinct(), "id", "left_anti"))
        if not pending.take(1):
            break
        size *= 2
    return (out if ties else out.where(f"nth <= {k}")).drop("place")


def one_to_one_nearest(pairs: DataFrame) -> DataFrame:
    """Greedy 1:1 pairs: of each query the nearest point, then of each point the nearest query."""
    first = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "r_id"))).where("_k = 1").drop("_k")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("r_id").orderBy("d", "q_id"))).where("_k = 1").drop("_k")


#: Times k + 1: more points than that in a bin call for the tree.
CROWDED = 64
#: Points of a leaf, levels of the tree, and binary levels from one of its levels to the next: a node has 16 children.
LEAF, DEPTH, STEP = 32, 16, 2


def fullest(points: DataFrame, size: float) -> int:
    """Points of the fullest bin: one number to the driver."""
    return points.groupBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).count().agg(F.max("count")).first()[0] or 0


def _cells(df: DataFrame, x0: float, y0: float, extent: float, level: int) -> DataFrame:
    bins = float(1 << STEP * level)
    at = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(extent) * bins), F.lit(int(bins) - 1))
    return df.withColumns({"cx": at("x", x0), "cy": at("y", y0)})


def quadtree(points: DataFrame, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame, tuple[float, float, float]]:
    """Of a tree of square cells: for each level its nodes (cx, cy, n, is_leaf); the points with the leaf that holds them (level, cx, cy); the square.

    Counts by cell decide: a cell of more than ``leaf`` points is split into 16, so a dense place is cut fine and an empty
    one not at all. Cells of the last level stay whole; only points within a 2**-30th of the extent share one.
    """
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    extent = max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
    nodes, placed, rest = [], None, points.select("id", "x", "y")
    for level in range(DEPTH):
        here = _cells(rest, x0, y0, extent, level)
        counts = here.groupBy("cx", "cy").agg(F.count("*").alias("n"))
        counts = settled(counts.withColumn("is_leaf", (F.col("n") <= leaf) | F.lit(level == DEPTH - 1)))
        nodes.append(counts)
        met = here.join(counts.select("cx", "cy", "is_leaf"), ["cx", "cy"])
        done = settled(met.where("is_leaf").select("id", "x", "y", F.lit(level).alias("level"), "cx", "cy"))
        placed = done if placed is None else placed.unionByName(done)
        rest = settled(met.where("NOT is_leaf").select("id", "x", "y"))
        if not rest.take(1):
            break
    return nodes, placed, (x0, y0, extent)


def nearest_by_tree(queries: DataFrame, points: DataFrame, k: int = 1, self_join: bool = False, ties: bool = False, leaf: int = LEAF) -> DataFrame:
    """What ``nearest`` gives, by a quadtree: each query keeps the cells that can still hold one of its k nearest points.

    A round replaces inner cells by their children. The cells that surely hold k points, by their far corners, bound the
    k-th distance; cells that begin beyond it leave. At the end a query has a few leaves, of ``leaf`` points each, so its
    work grows neither with the fullest place nor with the emptiest. With ``self_join`` its own place counts as one more.
    """
    nodes, placed, (x0, y0, extent) = quadtree(points, leaf)
    wanted = k + (1 if self_join else 0)
    ask = settled(queries.selectExpr("id AS q_id", "CAST(x AS DOUBLE) AS q_x", "CAST(y AS DOUBLE) AS q_y"))
    total = nodes[0].first()["n"]

    def gaps(side: float) -> dict:
        out = {}
        for c, low in (("x", x0), ("y", y0)):
            start = F.lit(low) + F.col(f"c{c}") * F.lit(side)
            out[f"near_{c}"] = F.greatest(start - F.col(f"q_{c}"), F.col(f"q_{c}") - start - F.lit(side), F.lit(0.0))
            out[f"far_{c}"] = F.greatest(F.abs(F.col(f"q_{c}") - start), F.abs(start + F.lit(side) - F.col(f"q_{c}")))
        return out

    front = ask.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long"), "level": F.lit(0), "is_leaf": F.lit(len(nodes) == 1), "n": F.lit(total), "near": F.lit(0.0), "far": F.lit(float("inf"))})
    slack = 1e-9 * extent  # cells are cut by rounded arithmetic
    for level in range(1, len(nodes)):
        side = extent / (1 << STEP * level)
        children = nodes[level].select(F.shiftright("cx", STEP).alias("px"), F.shiftright("cy", STEP).alias("py"), "cx", "cy", "n", "is_leaf")
        inner = front.where("NOT is_leaf").select("q_id", "q_x", "q_y", F.col("cx").alias("px"), F.col("cy").alias("py")).join(children, ["px", "py"]).withColumns(gaps(side))
        inner = inner.select("q_id", "q_x", "q_y", "cx", "cy", F.lit(level).alias("level"), "is_leaf", "n", (F.hypot("near_x", "near_y") - slack).alias("near"), (F.hypot("far_x", "far_y") + slack).alias("far"))
        both = front.where("is_leaf").select(*inner.columns).unionByName(inner)
        sure = F.sum("n").over(Window.partitionBy("q_id").orderBy("far"))
        bound = F.coalesce(F.min(F.when(F.col("held") >= wanted, F.col("far"))).over(Window.partitionBy("q_id")), F.lit(float("inf")))
        front = settled(both.withColumn("held", sure).withColumn("bound", bound).where("near <= bound").drop("held", "bound"))
    pairs = front.select("q_id", "q_x", "q_y", "level", "cx", "cy").join(placed.select(F.col("id").alias("r_id"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), "level", "cx", "cy"), ["level", "cx", "cy"]).withColumn("d", distance())
    if self_join:
        pairs = pairs.where("q_id != r_id")
    found = pairs.select("q_id", "r_id", "d", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "r_id")).alias("nth"), F.rank().over(Window.partitionBy("q_id").orderBy("d")).alias("place"))
    return found.where(f"place <= {k}" if ties else f"nth <= {k}").drop("place")
