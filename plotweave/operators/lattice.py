"""Hexagon lattice: cells of points and segments by arithmetic, rollups, multiplicities.

A lattice is its parameters. Flat-top cells of spacing s lie in columns s*sqrt(3)/2 apart, every other column half a cell
lower; a cell is the set of points nearest to its centre, so no polygon is ever built to find one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


@dataclass(frozen=True)
class Lattice:
    origin_x: float
    origin_y: float
    spacing: float

    @property
    def step(self) -> float:
        return self.spacing * math.sqrt(3) / 2

    @property
    def radius(self) -> float:
        return self.spacing / math.sqrt(3)

    def centre_x(self, col: Column) -> Column:
        return F.lit(self.origin_x) + col * F.lit(self.step)

    def centre_y(self, row: Column, col: Column) -> Column:
        return F.lit(self.origin_y) - row * F.lit(self.spacing) - F.pmod(col, F.lit(2)) * F.lit(self.spacing / 2)

    def vertices(self, row: Column, col: Column) -> Column:
        """The six corners, from the right one on, as an array of (x, y)."""
        cx, cy = self.centre_x(col), self.centre_y(row, col)
        return F.array(*(F.struct((cx + self.radius * math.cos(math.pi / 3 * k)).alias("x"), (cy + self.radius * math.sin(math.pi / 3 * k)).alias("y")) for k in range(6)))

    def cells(self, spark, width: float, height: float) -> DataFrame:
        """row_index, col_index, cell, cx, cy of all cells whose centre lies in the box that runs right and down from the origin."""
        cols = spark.range(int(width / self.step) + 1).select(F.col("id").cast("int").alias("col_index"))
        rows = spark.range(int(height / self.spacing) + 1).select(F.col("id").cast("int").alias("row_index"))
        out = cols.crossJoin(rows).select("row_index", "col_index", cell_id(F.col("row_index"), F.col("col_index")).alias("cell"), self.centre_x(F.col("col_index")).alias("cx"), self.centre_y(F.col("row_index"), F.col("col_index")).alias("cy"))
        return out.where(F.col("cy") >= self.origin_y - height)


def cell_id(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def assign(df: DataFrame, lattice: Lattice, x: str = "x", y: str = "y", out: str = "cell") -> DataFrame:
    """Adds the cell of each point, null on an edge that two cells share. Only two columns can hold a point, and two rows of each: four centres, no join."""
    u = F.floor((F.col(x) - lattice.origin_x) / lattice.step)
    near = []
    for k in (0, 1):
        col = u + k
        v = F.floor((F.lit(lattice.origin_y) - F.col(y) - F.pmod(col, F.lit(2)) * (lattice.spacing / 2)) / lattice.spacing)
        for j in (0, 1):
            row = v + j
            dx, dy = F.col(x) - lattice.centre_x(col), F.col(y) - lattice.centre_y(row, col)
            near.append((dx * dx + dy * dy, row, col))
    least = F.least(*(d for d, _, _ in near))
    alone = sum((d == least).cast("int") for d, _, _ in near) == 1
    pick = lambda n: F.coalesce(*(F.when(c[0] == least, c[n]) for c in near))
    return df.withColumn(out, F.when(alone, cell_id(pick(1), pick(2))))


# The directions of the three pairs of edges.
NORMALS = tuple((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (90, 30, 150))


def _cut_batches(ox: float, oy: float, s: float, step: float, r: float, normals: Sequence[tuple[float, float]], ends: Sequence[str], names: Sequence[str]):
    """The rows of a batch for each cell that a segment meets, with row and column of the cell and the length inside."""
    import numpy as np
    import pyarrow as pa

    def spread(first, last):
        n = np.maximum(last - first + 1, 0).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]

    def run(batches):
        margin = s * 1e-9
        for batch in batches:
            x1, y1, x2, y2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ends)
            known = np.flatnonzero(np.isfinite(x1 + y1 + x2 + y2))
            x1, y1, x2, y2 = x1[known], y1[known], x2[known], y2[known]
            at, col = spread(np.ceil((np.minimum(x1, x2) - (r + margin) - ox) / step), np.floor((np.maximum(x1, x2) + (r + margin) - ox) / step))
            known, x1, y1, x2, y2 = known[at], x1[at], y1[at], x2[at], y2[at]
            low, high, wide = np.minimum(x1, x2), np.maximum(x1, x2), np.where(x1 == x2, 1.0, x2 - x1)
            enters, leaves = (np.where(x1 == x2, y, y1 + (np.minimum(np.maximum(ox + col * step + side, low), high) - x1) / wide * (y2 - y1)) for side, y in ((-r - margin, y1), (r + margin, y2)))
            middle = oy - col % 2 * (s / 2)
            at, row = spread(np.ceil((middle - np.maximum(enters, leaves) - (s / 2 + margin)) / s), np.floor((middle - np.minimum(enters, leaves) + (s / 2 + margin)) / s))
            known, col, x1, y1, x2, y2 = known[at], col[at], x1[at], y1[at], x2[at], y2[at]
            cx, cy = ox + col * step, oy - row * s - col % 2 * (s / 2)
            enter, leave, inside = np.zeros(len(at)), np.ones(len(at)), np.ones(len(at), bool)
            for nx, ny in normals:
                a, by = (x1 - cx) * nx + (y1 - cy) * ny, (x2 - x1) * nx + (y2 - y1) * ny
                runs = by != 0
                over = np.where(runs, by, 1.0)
                u, v = (-s / 2 - a) / over, (s / 2 - a) / over
                enter, leave = np.where(runs, np.maximum(enter, np.minimum(u, v)), enter), np.where(runs, np.minimum(leave, np.maximum(u, v)), leave)
                inside &= runs | (np.abs(a) <= s / 2)
            k = np.flatnonzero(inside & (enter <= leave))
            part = (leave[k] - enter[k]) * np.hypot(x2[k] - x1[k], y2[k] - y1[k])
            rows = pa.array(known[k])
            yield pa.record_batch([*(batch.column(c).take(rows) for c in names), pa.array(row[k].astype(np.int64)), pa.array(col[k].astype(np.int64)), pa.array(part)], [*names, "_r", "_c", "part"])

    return run


def cut_by_cells(df: DataFrame, lattice: Lattice, ends: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """One row per segment and cell that it meets, with ``cell`` and ``part``, the length inside.

    Columns within reach of the segment are walked, and in each the rows within reach of the part of the segment that runs
    there, so candidates grow with the length and not with the box. A cell is the meet of three bands, and clipping the
    segment's parameter by each (Liang and Barsky) leaves an interval that is empty exactly when they don't meet. It is done
    on Arrow batches, as these expressions are too long for compiled code.
    """
    of = _cut_batches(lattice.origin_x, lattice.origin_y, lattice.spacing, lattice.step, lattice.radius, NORMALS, tuple(ends), tuple(df.columns))
    schema = StructType([*df.schema.fields, StructField("_r", LongType()), StructField("_c", LongType()), StructField("part", DoubleType())])
    return df.mapInArrow(of, schema).select(*df.columns, cell_id(F.col("_r"), F.col("_c")).alias("cell"), "part")


def majority_cell(cut: DataFrame, key: str) -> DataFrame:
    """The cell with the longest part of each segment; equal parts (to 1e-6) go to the first cell by name."""
    order = Window.partitionBy(key).orderBy(F.round("part", 6).desc(), "cell")
    return cut.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def rollup(df: DataFrame, cells: DataFrame, roles: dict[str, str], cell: str = "cell") -> DataFrame:
    """All cells with n and, per measure, the mean (accessibility) or the sum (intermediation)."""
    pick = {"accessibility": F.avg, "intermediation": F.sum}
    per = df.groupBy(cell).agg(F.count("*").alias("n"), *(pick[role](c).alias(c) for c, role in roles.items()))
    return cells.select(cell).join(per, cell, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def point_rollup(df: DataFrame, cells: DataFrame, value: str, cell: str = "cell", least: int = 3) -> DataFrame:
    """All cells with n, mean, median and shown, the median of cells with ``least`` values or more."""
    per = df.groupBy(cell).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return cells.select(cell).join(per, cell, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("shown", F.when(F.col("n") >= least, F.col("median")))


def implied_counts(df: DataFrame, key: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """key, implied (the mode over measures of round(sum / mean), the smallest on ties), most (largest deviation), n_off."""
    ns = F.array(*(F.rint(F.try_divide(F.col(s), F.col(m))) for s, m in pairs))
    long = df.select(key, F.explode(ns).alias("v")).where("v IS NOT NULL")
    mode = long.groupBy(key).agg(F.expr("mode() WITHIN GROUP (ORDER BY v)").alias("implied"))
    return long.join(mode, key).groupBy(key, "implied").agg(F.max(F.abs(F.col("v") - F.col("implied"))).alias("most"), F.count_if(F.col("v") != F.col("implied")).alias("n_off"))
