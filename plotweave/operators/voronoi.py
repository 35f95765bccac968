"""Voronoi cells of sites within a box, and the areas that segments own by the cells of points along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import convex, overlay, validate
from .lineage import settled
from .near import nearest

#: Joins of sites are sorted: broadcast, a frame just below the threshold would pass through the driver in each round.
SORTED = "merge"

#: Neighbours that a cell is first cut by.
FIRST = 24


def distinct_sites(sites: DataFrame) -> DataFrame:
    """Of sites (id, x, y) at one place that with the least id."""
    return sites.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y")


def _cut(cells: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Cells (id, x, y, cell; corners as seen from the site) cut by the bisectors with their ``neighbours`` (id, tx, ty)."""
    planes = neighbours.groupBy("id").agg(F.collect_list(convex.bisector(F.col("tx"), F.col("ty"))).alias("planes"))
    return cells.join(planes.hint(SORTED), "id").select("id", "x", "y", convex.clipped(F.col("cell"), F.col("planes")).alias("cell"))


def cells(sites: DataFrame, bounds: tuple[float, float, float, float], first: int = FIRST, shapes: DataFrame | None = None) -> DataFrame:
    """id and cell: what of the box (x0, y0, x1, y1) is nearer to the site than to any other, as corners counter-clockwise.

    A cell is cut by its ``first`` nearest neighbours. Whatever lies further than twice its furthest corner can't cut it,
    so most cells are final at once. Of the others each corner asks for its nearest site: where that is another than the
    cell's own, the cell is cut by it and asks again; where none is, the cell is final, as a site that cuts a convex cell
    is nearer to one of its corners. A cell's work grows with its sides, however uneven the density is. Sites outside of
    the box raise no error, their cells are what the box has of them; of sites at one place only that with the least id
    has a cell. With ``shapes`` (id, shape; convex) a site gets what of its cell is in its shape, which ends the sooner.
    """
    sites = settled(distinct_sites(sites).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).hint(SORTED)
    x0, y0, x1, y1 = (F.lit(float(b)) for b in bounds)
    whole = sites.withColumn("cell", convex.box(x0 - F.col("x"), y0 - F.col("y"), x1 - F.col("x"), y1 - F.col("y")))
    if shapes is not None:
        moved = F.transform("shape", lambda p: convex.corner(p["x"] - F.col("x"), p["y"] - F.col("y")))
        whole = whole.join(shapes.hint(SORTED), "id").withColumn("cell", convex.clipped(moved, convex.half_planes(F.col("cell")))).drop("shape")
    place = sites.select(F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    known = settled(nearest(sites, sites, first, self_join=True).join(place, "r_id").join(sites, F.col("q_id") == F.col("id")).select("id", "d", (F.col("rx") - F.col("x")).alias("tx"), (F.col("ry") - F.col("y")).alias("ty")))
    reach = known.groupBy("id").agg(F.max("d").alias("far"), F.count("*").alias("n"))
    furthest = F.coalesce(F.array_max(F.transform("cell", lambda p: F.hypot(p["x"], p["y"]))), F.lit(0.0))
    now = settled(_cut(whole, known).join(reach.hint(SORTED), "id").withColumn("sure", (F.col("n") < first) | (2 * furthest <= F.col("far"))).drop("far", "n"))
    alone = whole.join(known.select("id").distinct().hint(SORTED), "id", "left_anti").drop("x", "y")
    done, pending = now.where("sure").select("id", "x", "y", "cell"), now.where("NOT sure").drop("sure")
    margin = 1e-9 * max(abs(float(b)) for b in bounds)
    while pending.take(1):
        corners = pending.select("id", "x", "y", F.posexplode("cell").alias("k", "p")).select(F.struct("id", "k").alias("id"), (F.col("x") + F.col("p.x")).alias("x"), (F.col("y") + F.col("p.y")).alias("y"), F.hypot("p.x", "p.y").alias("own"))
        corners = settled(corners)
        met = nearest(corners, sites, 1).join(corners.select(F.col("id").alias("q_id"), "own").hint(SORTED), "q_id").where(F.col("d") < F.col("own") - margin)
        new = met.select(F.col("q_id.id").alias("id"), "r_id").distinct().join(place, "r_id").join(sites, "id").select("id", (F.col("rx") - F.col("x")).alias("tx"), (F.col("ry") - F.col("y")).alias("ty"))
        new = settled(new)
        done = done.unionByName(pending.join(new.select("id").distinct().hint(SORTED), "id", "left_anti"))
        pending = settled(_cut(pending, new))
    placed = done.withColumn("cell", F.transform("cell", lambda p: convex.corner(p["x"] + F.col("x"), p["y"] + F.col("y"))))
    return placed.select("id", "cell").unionByName(alone.join(sites, "id").select("id", F.transform("cell", lambda p: convex.corner(p["x"] + F.col("x"), p["y"] + F.col("y"))).alias("cell")))


def owned_parts(seg: DataFrame, points: DataFrame, bounds: tuple[float, float, float, float], width: float, quarter: int = 8) -> DataFrame:
    """seg, id and part: for each of ``points`` (id, seg, x, y) along the segments what of its cell is at most ``width`` from its segment.

    Cells and buffers are convex, so parts are, too, and parts don't overlap: the areas of a segment's parts add up.
    """
    shape = seg.select("seg", convex.capsule(*map(F.col, ("x1", "y1", "x2", "y2")), width, quarter).alias("buffer"))
    shapes = points.select("id", "seg").join(shape, "seg").select("id", F.col("buffer").alias("shape"))
    parts = cells(points.select("id", "x", "y"), bounds, shapes=shapes).join(points.select("id", "seg"), "id")
    return parts.select("seg", "id", F.col("cell").alias("part")).where(F.size("part") > 2)


def owned_areas(seg: DataFrame, bounds: tuple[float, float, float, float], width: float, roads: DataFrame | None = None, step: float = 5.0, least: float = 10.0, quarter: int = 8) -> DataFrame:
    """seg and area of every segment (seg, x1, y1, x2, y2): of what is at most ``width`` from it the part that is nearest to its own points, without the ``roads`` (poly, edges).

    Points are set each ``step`` along the segments and thinned, the first of a square metre staying; areas below ``least``
    are 0, as are those of segments that have lost all their points. Where all roads are convex, each part is cut by the roads
    that it meets; only others call for an overlay of all edges.
    """
    points = validate.thinned_samples(seg.withColumnRenamed("seg", "id"), step)
    points = settled(points.select(F.struct("id", "enum").alias("id"), F.col("id").alias("seg"), "x", "y"))
    parts = settled(owned_parts(seg, points, bounds, width, quarter))
    roads = roads if roads is None else settled(roads.select("poly", "edges"))
    if roads is None:
        found = parts.groupBy("seg").agg(F.sum(convex.area(F.col("part"))).alias("area"))
    elif not roads.where(~convex.is_convex(F.col("edges"))).take(1):
        left = convex.uncovered(parts.select(F.col("id").alias("name"), "part"), roads)
        found = left.groupBy(F.col("name.id").alias("seg")).agg(F.sum("area").alias("area"))
    else:
        own = parts.select(F.lit("own").alias("layer"), F.concat_ws(":", F.col("id.id").cast("string"), F.col("id.enum").cast("string")).alias("poly"), convex.edges(F.col("part")).alias("edges"))
        road = roads.select(F.lit("road").alias("layer"), F.col("poly").cast("string").alias("poly"), "edges")
        left = overlay.areas(overlay.boundary(overlay.faces(own.unionByName(road)), overlay.own_label("own", "road")))
        names = parts.select("seg", F.concat_ws(":", F.col("id.id").cast("string"), F.col("id.enum").cast("string")).alias("label"))
        found = names.join(left, "label").groupBy("seg").agg(F.sum("area").alias("area"))
    shown = F.when(F.col("area") >= least, F.col("area")).otherwise(0.0)
    return seg.select("seg").join(found, "seg", "left").select("seg", shown.alias("area"))
