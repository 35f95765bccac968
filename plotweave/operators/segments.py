"""Points and the segments nearest to them: bins along the segments, exact distances after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import settled
from .near import _around, bin_size

ENDS = ("x1", "y1", "x2", "y2")


def along(seg: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """r_id, ends, bx, by: a row for each bin that a segment (seg, x1, y1, x2, y2) passes through, or comes within ``reach`` of.

    Columns are walked, and in each the rows between the two places where the segment meets its sides, so the rows grow
    with the length and not with the box.
    """
    base = seg.selectExpr("seg AS r_id", *ENDS, "x2 - x1 AS dx", "y2 - y1 AS dy", f"floor((least(x1, x2) - {reach}D) / {size}D) AS b0", f"floor((greatest(x1, x2) + {reach}D) / {size}D) AS b1")
    walked = base.withColumn("bx", F.explode(F.sequence("b0", "b1")))
    at = lambda x: f"IF(dx = 0, NULL, y1 + (least(greatest({x}, least(x1, x2)), greatest(x1, x2)) - x1) / dx * dy)"
    rows = walked.withColumns({"u": F.expr(at(f"bx * {size}D - {reach}D")), "v": F.expr(at(f"(bx + 1) * {size}D + {reach}D"))})
    margin = reach + size * 1e-9
    low, high = f"floor((IF(dx = 0, least(y1, y2), least(u, v)) - {margin!r}D) / {size}D)", f"floor((IF(dx = 0, greatest(y1, y2), greatest(u, v)) + {margin!r}D) / {size}D)"
    return rows.withColumn("by", F.explode(F.expr(f"sequence({low}, {high})"))).select("r_id", *ENDS, "bx", "by")


#: The distance of a point (q_x, q_y) from a segment, by the place along it that is nearest.
DISTANCE = "sqrt(pow(q_x - (x1 + t * (x2 - x1)), 2) + pow(q_y - (y1 + t * (y2 - y1)), 2))"
PLACE = "CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0D ELSE least(greatest(((q_x - x1) * (x2 - x1) + (q_y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0D), 1.0D) END"


#: Points of a tile, on the average, and segments that meet a tile's points in one product of matrices.
TILE_POINTS, BLOCK = 256, 512


def _near_in_tiles(first: float):
    """Rows sorted by tile, a tile's points (k = 0) before its segments: pairs that may be nearest, segments streaming past the points of one tile.

    The distance from a segment's line, a product of matrices, is no more than that from the segment: only pairs for which
    it is within the point's best so far (``first`` at the start) are measured. Their distances only rule out, with slack.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        tile, points, best, ids = None, np.empty((0, 3)), np.empty(0), None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*ENDS, "bx", "by", "k")}
            starts = np.flatnonzero(np.r_[True, (np.diff(cols["bx"]) != 0) | (np.diff(cols["by"]) != 0)]) if batch.num_rows else np.empty(0, int)
            out = []
            for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
                if (cols["bx"][a], cols["by"][a]) != tile:
                    tile, points, ids = (cols["bx"][a], cols["by"][a]), np.empty((0, 3)), batch.column("q_id").slice(0, 0)
                m = a + int(np.count_nonzero(cols["k"][a:b] == 0))
                if m > a:
                    points = np.concatenate([points, np.c_[cols["x1"][a:m], cols["y1"][a:m], np.ones(m - a)]])
                    ids, best = pa.concat_arrays([ids, batch.column("q_id").slice(a, m - a)]), np.full(len(points), first)
                for s in range(m, b if len(points) else m, BLOCK):
                    cut = slice(s, min(s + BLOCK, b))
                    x1, y1, dx, dy = cols["x1"][cut], cols["y1"][cut], cols["x2"][cut] - cols["x1"][cut], cols["y2"][cut] - cols["y1"][cut]
                    length = np.hypot(dx, dy)
                    unit = np.where(length > 0, length, 1.0)
                    nx, ny = -dy / unit, dx / unit  # no length: zeros, every pair is measured
                    lines = np.stack([nx, ny, -(nx * x1 + ny * y1)])
                    slack = 1e-9 * (1.0 + np.abs(lines[2]).max())
                    for g in range(0, len(points), 4 * TILE_POINTS):
                        own = slice(g, g + 4 * TILE_POINTS)
                        i, j = np.nonzero(np.abs(points[own] @ lines) <= best[own, None] + slack)
                        i = i + g
                        px, py = points[i, 0] - x1[j], points[i, 1] - y1[j]
                        t = np.clip((px * dx[j] + py * dy[j]) / (unit[j] * unit[j]), 0.0, 1.0)
                        d = np.hypot(px - t * dx[j], py - t * dy[j])
                        np.minimum.at(best, i, d)
                        kept = d <= best[i] + slack
                        if kept.any():
                            i, j = i[kept], j[kept] + s
                            out.append(pa.record_batch([ids.take(pa.array(i)), pa.array(points[i, 0]), pa.array(points[i, 1]), *(batch.column(c).take(pa.array(j)) for c in ("r_id", *ENDS))], ["q_id", "q_x", "q_y", "r_id", *ENDS]))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run


def nearest_segments(points: DataFrame, seg: DataFrame, size: float | None = None) -> DataFrame:
    """q_id, r_id, d, nth, tied: the nearest segments of each point (id, x, y); equidistant ones all stay, in order of r_id.

    Points lie in tiles that hold some hundreds of them, and segments go to all tiles that they come within ``size`` of. A
    tile's segments stream past its points, whose best distances so far leave few pairs to hand on, and the least distance
    is taken from those. An answer stands where it is at most ``size``; the other points are asked again with twice that.
    """
    middles = seg.selectExpr("(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y")
    own, extent = bin_size(points, middles, 1)
    wide, widest = bin_size(points, points, TILE_POINTS - 1)
    reach = seg.agg(F.max(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 0.0
    size, extent = size or own, extent + reach
    parts = 4 * max(seg.sparkSession.sparkContext.defaultParallelism, int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seg = seg.where(" AND ".join(f"{c} IS NOT NULL" for c in ENDS))
    kinds = {"q": points.schema["id"].dataType.simpleString(), "r": seg.schema["seg"].dataType.simpleString()}
    pending, out = points.selectExpr("id AS q_id", "CAST(x AS DOUBLE) AS q_x", "CAST(y AS DOUBLE) AS q_y").where("q_x IS NOT NULL AND q_y IS NOT NULL"), None
    while True:
        tile, last = max(wide, size), size >= extent
        at = pending.select("q_id", F.col("q_x").alias("x1"), F.col("q_y").alias("y1"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"), F.lit(None).cast(kinds["r"]).alias("r_id"), F.floor(F.col("q_x") / tile).alias("bx"), F.floor(F.col("q_y") / tile).alias("by"), F.lit(0).alias("k"))
        filed = along(seg, tile, size).select(F.lit(None).cast(kinds["q"]).alias("q_id"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "r_id", "bx", "by", F.lit(1).alias("k"))
        if out is not None:
            filed = filed.join(at.select("bx", "by").distinct(), ["bx", "by"], "left_semi").select(*at.columns)
        rows = at.select(*at.columns).unionByName(filed).repartition(parts, "bx", "by").sortWithinPartitions("bx", "by", "k")
        met = rows.mapInArrow(_near_in_tiles(float("inf") if last else size), f"q_id {kinds['q']}, q_x double, q_y double, r_id {kinds['r']}, x1 double, y1 double, x2 double, y2 double")
        met = settled(met.withColumn("t", F.expr(PLACE)).select("q_id", "r_id", F.expr(DISTANCE).alias("d")))
        least = met.groupBy("q_id").agg(F.min("d").alias("d")).where(F.lit(last) | (F.col("d") <= size))
        sure = settled(met.join(least, ["q_id", "d"]).select("q_id", "r_id", "d").distinct())
        out = sure if out is None else out.unionByName(sure)
        if last:
            break
        pending = settled(pending.join(sure.select("q_id").distinct(), "q_id", "left_anti"))
        if not pending.take(1):
            break
        size *= 2
    each = Window.partitionBy("q_id")
    return out.withColumns({"nth": F.row_number().over(each.orderBy("r_id")), "tied": F.count("*").over(each) > 1})


def snap_statistics(nearest: DataFrame) -> DataFrame:
    """One row: points, points with ties, median, 90th percentile and largest distance."""
    one = nearest.where("nth = 1")
    return one.agg(F.count("*").alias("n"), F.count_if("tied").alias("n_tied"), F.median("d").alias("median"), F.percentile("d", 0.9).alias("p90"), F.max("d").alias("most"))


def point_coverage(nearest: DataFrame, variant: DataFrame, value: str) -> DataFrame:
    """q_id, covered and ``value`` of each point: a point counts only where its nearest reference segment is in ``variant`` (seg, value)."""
    kept = variant.select(F.col("seg").alias("r_id"), value, F.lit(True).alias("covered"))
    return nearest.where("nth = 1").select("q_id", "r_id").join(kept, "r_id", "left").select("q_id", F.coalesce("covered", F.lit(False)).alias("covered"), value)
