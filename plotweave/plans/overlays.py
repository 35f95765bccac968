"""Queries on cells and overlays: suppliers are sites, the middles of blocks and plots, and the ends of lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import convex, overlay, polygons as pg, variants, voronoi
from ..operators.lineage import settled
from . import inputs
from .areas import ED, plots
from .inputs import PT
from .register import query
from .spatial import EXTENT, SUP, suppliers

BOUNDS = (0.0, 0.0, EXTENT, EXTENT)
_D2 = "(p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)"


@query()
def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's cell: corners and area."""
    return voronoi.cells(suppliers(spark, sf_dir), BOUNDS).select("id", F.size("cell").alias("corners"), F.round(convex.area(F.col("cell")), 3).alias("area"))


@query(f"WITH {SUP} SELECT count(DISTINCT struct_pack(x := x, y := y)) AS cells, round({EXTENT}::DOUBLE * {EXTENT}::DOUBLE, 2) AS area FROM sup")
def voronoi_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells neither overlap nor leave anything: their areas add up to the box."""
    return voronoi.cells(suppliers(spark, sf_dir), BOUNDS).agg(F.count("*").alias("cells"), F.round(F.sum(convex.area(F.col("cell"))), 2).alias("area"))


@query(f"WITH {PT}, {SUP}, n AS (SELECT p.id, s.id AS cell, rank() OVER (PARTITION BY p.id ORDER BY {_D2}) AS place, count(*) OVER (PARTITION BY p.id, {_D2}) AS tied FROM pt p, sup s) SELECT id, cell FROM n WHERE place = 1 AND tied = 1")
def voronoi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that each customer lies in, found by its sides; customers on a side (of whole-number places, within 1e-6 of one) have none."""
    cells = voronoi.cells(suppliers(spark, sf_dir), (-1.0, -1.0, EXTENT + 1, EXTENT + 1)).select(F.col("id").alias("poly"), "cell")
    points = inputs.points(spark, sf_dir)
    found = pg.points_in_polygons(points, cells.select("poly", convex.edges(F.col("cell")).alias("edges")))
    clear = lambda h: h["c"] - h["a"] * F.col("x") - h["b"] * F.col("y") > 1e-6 * F.hypot(h["a"], h["b"])
    return found.join(points.select("id", "x", "y"), "id").join(cells, "poly").where(F.forall(convex.half_planes(F.col("cell")), clear)).select("id", F.col("poly").alias("cell"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upright block around each supplier, in two layers by turns."""
    ring = F.array(*(F.struct(F.expr(f"x {x} w").alias("x"), F.expr(f"y {y} h").alias("y")) for x, y in ("--", "+-", "++", "-+")))
    sized = suppliers(spark, sf_dir).selectExpr("id", "x", "y", "200D + id % 5 * 40 AS w", "150D + id % 7 * 30 AS h")
    return sized.select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("layer"), F.col("id").cast("string").alias("poly"), convex.edges(ring).alias("edges"))


_BLOCKS = f"{SUP}, bx AS (SELECT id, id % 2 AS odd, x - w AS x0, x + w AS x1, y - h AS y0, y + h AS y1 FROM (SELECT *, 200.0::DOUBLE + id % 5 * 40 AS w, 150.0::DOUBLE + id % 7 * 30 AS h FROM sup)), xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM (SELECT x0 AS x FROM bx UNION SELECT x1 FROM bx)), ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS ny FROM (SELECT y0 AS y FROM bx UNION SELECT y1 FROM bx)), sl AS (SELECT x, nx, odd, y0, y1 FROM xs JOIN bx ON x0 <= x AND x1 >= nx)"
_RUNS = "SELECT x, nx, y0, y1, max(y1) OVER (PARTITION BY x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {rows}"
_SUM = "sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(m, y0))))"


@query(f"WITH {_BLOCKS}, u AS ({_RUNS.format(rows='sl')}), ua AS ({_RUNS.format(rows='(SELECT * FROM sl WHERE odd = 0)')}), ub AS ({_RUNS.format(rows='(SELECT * FROM sl WHERE odd = 1)')}), t AS (SELECT (SELECT {_SUM} FROM u) AS total, (SELECT {_SUM} FROM ua) AS a, (SELECT {_SUM} FROM ub) AS b) SELECT round(total, 3) AS area_union, round(a + b - total, 3) AS area_both, round(total - b, 3) AS area_only_a, round(total - a, 3) AS area_only_b FROM t")
def block_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and both differences of two layers of overlapping blocks, from one arrangement of their edges; the SQL sweeps strips."""
    found = overlay.regions(_blocks(spark, sf_dir), ("a", "b"))
    labels = {"area_union": overlay.union_label("a", "b"), "area_both": overlay.intersection_label("a", "b"), "area_only_a": overlay.difference_label("a", "b"), "area_only_b": overlay.difference_label("b", "a")}
    # a piece counts for every overlay in which its sides differ, to the left or to the right
    turn = (F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2
    side = lambda label, name: F.coalesce(label(F.col(name)), F.lit(False)).cast("int")
    return found.agg(*(F.round(F.sum(turn * (side(label, "left") - side(label, "right"))), 3).alias(name) for name, label in labels.items()))


_NEAR = "min(sqrt((x - px - t * (qx - px)) * (x - px - t * (qx - px)) + (y - py - t * (qy - py)) * (y - py - t * (qy - py))))"
_CROSS = "count(*) FILTER ((py > y) <> (qy > y) AND x < px + (qx - px) * (y - py) / (qy - py)) % 2 = 1"


@query(f"WITH {PT}, {ED}, c AS (SELECT id, x, y, poly, px, py, qx, qy, greatest(0.0, least(1.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / ((qx - px) * (qx - px) + (qy - py) * (qy - py)))) AS t FROM pt, ed), o AS (SELECT id, poly, {_CROSS} AS inner_, {_NEAR} AS d FROM c GROUP BY id, poly) SELECT id FROM o GROUP BY id HAVING bool_or(inner_) AND min(d) > 0.001")
def plots_union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the dissolved plots, by the rings of the dissolved boundary alone, but for those within a thousandth of any plot's edge."""
    own = plots(spark, sf_dir)
    bound = overlay.joined(overlay.regions(own.select(F.lit("own").alias("layer"), F.col("poly").cast("string").alias("poly"), "edges"), ("own",)), overlay.union_label("own"))
    points = inputs.points(spark, sf_dir)
    within = overlay.depths(points, settled(overlay.rings(bound))).where("depth > 0")
    return within.join(overlay.near_sides(points, overlay.sides_of(own), 0.001), "id", "left_anti").select("id")


def _shape(name: str, bound: DataFrame) -> DataFrame:
    one = overlay.rings(bound).select("ring", "area").distinct()
    return one.agg(F.lit(name).alias("shape"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 1).alias("area"), F.count_if(F.col("area") > 0).alias("parts"), F.count_if(F.col("area") < 0).alias("holes"))


@query()
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plots widened by 60 and dissolved, with their holes and without: area, parts and holes."""
    widened = settled(overlay.buffered(plots(spark, sf_dir), 60.0, 2))
    return _shape("widened", widened).unionByName(_shape("filled", overlay.filled(widened)))


@query()
def inward_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dissolved plots narrowed by 40: area, parts and holes."""
    return _shape("narrowed", overlay.buffered(plots(spark, sf_dir), -40.0, 2))


#: Fixed values of this query: width of a lane's surface by class.
WIDTHS = {"0": 12.0, "1": 8.0}


@query()
def segment_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lane from each supplier: the area within 150 that no other lane is nearer to, without the lanes' own surface."""
    lanes = suppliers(spark, sf_dir).selectExpr("id AS seg", "id % 3 AS kind", "x AS x1", "y AS y1", "x + id % 11 * 40 - 200 AS x2", "y + id % 13 * 30 - 180 AS y2")
    lanes = lanes.repartition(overlay._tasks(lanes))  # a small file is one task, and its capsules are many
    half = variants.width_of(F.col("kind").cast("string"), WIDTHS) / 2
    roads = lanes.select(F.col("seg").alias("poly"), convex.edges(convex.capsule(*map(F.col, ("x1", "y1", "x2", "y2")), half)).alias("edges"))
    return voronoi.owned_areas(lanes.drop("kind"), (-500.0, -500.0, EXTENT + 500, EXTENT + 500), 150.0, roads, step=50.0).select("seg", F.round("area", 2).alias("area"))
