"""Convex polygons as arrays of corners (x, y) in counter-clockwise order: buffers of segments, clipping by half-planes, areas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CORNERS = "array<struct<x:double,y:double>>"


def corner(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def capsule(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | float, quarter: int = 8) -> Column:
    """All that is at most ``width`` from a segment, its round ends drawn with ``quarter`` chords to a right angle (corners lie on the circle)."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    angle = F.atan2(y2 - y1, x2 - x1)
    ends = []
    for x, y, turn in ((x2, y2, -math.pi / 2), (x1, y1, math.pi / 2)):
        for k in range(2 * quarter + 1):
            at = angle + (turn + math.pi * k / (2 * quarter))
            ends.append(corner(x + width * F.cos(at), y + width * F.sin(at)))
    return F.array(*ends)


def half_planes(corners: Column) -> Column:
    """For each side (a, b, c): a x + b y <= c holds inside."""

    def of(p: Column, i: Column) -> Column:
        q = F.element_at(corners, ((i + 1) % F.size(corners)) + 1)
        a, b = q["y"] - p["y"], p["x"] - q["x"]
        return F.struct(a.alias("a"), b.alias("b"), (a * p["x"] + b * p["y"]).alias("c"))

    return F.transform(corners, of)


def bisector(tx: Column, ty: Column) -> Column:
    """The half-plane of what is nearer to the origin than to (tx, ty)."""
    return F.struct(tx.alias("a"), ty.alias("b"), ((tx * tx + ty * ty) / 2).alias("c"))


def clipped(corners: Column, planes: Column) -> Column:
    """The corners of what lies in all half-planes; an empty array where nothing does."""

    def by(polygon: Column, h: Column) -> Column:
        out_by = lambda p: h["a"] * p["x"] + h["b"] * p["y"] - h["c"]

        def side(p: Column, i: Column) -> Column:
            q = F.element_at(polygon, ((i + 1) % F.size(polygon)) + 1)
            s, t = out_by(p), out_by(q)
            at = F.try_divide(s, s - t)
            met = corner(p["x"] + at * (q["x"] - p["x"]), p["y"] + at * (q["y"] - p["y"]))
            return F.concat(F.slice(F.array(p), 1, F.when(s <= 0, 1).otherwise(0)), F.slice(F.array(met), 1, F.when(((s < 0) & (t > 0)) | ((s > 0) & (t < 0)), 1).otherwise(0)))

        return F.flatten(F.transform(polygon, side))

    return F.aggregate(planes, corners.cast(CORNERS), by)


def area(corners: Column) -> Column:
    """By sums over sides, taken from the first corner to keep digits."""
    def of(s: Column, i: Column) -> Column:
        p, q, o = F.element_at(corners, i), F.element_at(corners, i % F.size(corners) + 1), F.element_at(corners, 1)
        return s + (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

    return F.when(F.size(corners) < 3, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(corners), F.lit(1))), F.lit(0.0), of) / 2)


def edges(corners: Column) -> Column:
    """The sides as (x1, y1, x2, y2), as polygons.py takes them."""

    def of(p: Column, i: Column) -> Column:
        q = F.element_at(corners, ((i + 1) % F.size(corners)) + 1)
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))

    return F.transform(corners, of)


#: Sides up to this length have no direction of their own: where a segment has no length, its two round ends meet in such.
SHORT = 1e-6


def is_convex(sides: Column) -> Column:
    """Whether ``sides`` (x1, y1, x2, y2, each beginning where the last ended) go once around a convex polygon counter-clockwise."""

    def once(long: Column) -> Column:
        def turn(e: Column, i: Column) -> Column:
            f = F.element_at(long, ((i + 1) % F.size(long)) + 1)
            ax, ay, bx, by = e["x2"] - e["x1"], e["y2"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]
            meets = F.hypot(f["x1"] - e["x2"], f["y1"] - e["y2"]) <= 2 * SHORT
            by = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
            return F.when(meets & (by > -1e-9), by).otherwise(float("inf"))

        return (F.size(long) > 2) & (F.abs(F.aggregate(F.transform(long, turn), F.lit(0.0), lambda s, t: s + t) - 2 * math.pi) < 1e-6)

    # within an array of one, so that the longer sides are found once
    return F.transform(F.array(F.filter(sides, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]) > SHORT)), once)[0]


#: Parts that a task of ``uncovered`` cuts at a time, pairs of a part and a cover that it looks at in one piece, and covers of a tile on the average.
PARTS, PAIRS, COVERS = 512, 1 << 15, 256


def _pieces(x, y, p):
    """Ragged polygons: first corner and number of corners of each piece, and of each corner the next; ``p`` numbers pieces upwards."""
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, int)
    n = np.diff(np.r_[first, len(p)])
    next_ = np.arange(1, len(p) + 1)
    next_[first + n - 1] = first
    return first, n, next_


def _half(x, y, p, d, next_):
    """What of the pieces lies where ``d``, a value at each corner, is at most 0."""
    e = d[next_]
    crossed = ((d < 0) & (e > 0)) | ((d > 0) & (e < 0))
    t = np.divide(d, d - e, out=np.zeros(len(d)), where=crossed)
    keep = np.stack([d <= 0, crossed], 1).ravel()
    both = lambda v: np.stack([v, v + t * (v[next_] - v)], 1).ravel()[keep]
    return both(x), both(y), np.repeat(p, 2)[keep]


def _sized(x, y, p):
    """The pieces without those that have no area, and the areas of the rest."""
    first, n, next_ = _pieces(x, y, p)
    if not len(first):
        return x, y, p, np.empty(0)
    ox, oy = np.repeat(x[first], n), np.repeat(y[first], n)
    area = np.add.reduceat((x - ox) * (y[next_] - oy) - (x[next_] - ox) * (y - oy), first) / 2
    keep = area > 1e-10
    return *(v[np.repeat(keep, n)] for v in (x, y, p)), area[keep]


def _left_over(polygons: list[np.ndarray], planes: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Of each convex polygon (corners as rows) the area outside of all covers, given by their half-planes (cover, side, a b c of unit length) and boxes.

    A cover takes from a piece, half-plane by half-plane, what is outside, as a new convex piece each; what is left at the end is covered.
    """
    count = np.array([len(v) for v in polygons])
    xy, part = np.concatenate(polygons), np.repeat(np.arange(len(polygons)), count)
    first = np.cumsum(count) - count
    low, high = np.minimum.reduceat(xy, first), np.maximum.reduceat(xy, first)
    middle, reach = (low + high) / 2, np.hypot(*((high - low) / 2).T)
    i, j = np.nonzero((low[:, None, 0] <= boxes[None, :, 2]) & (high[:, None, 0] >= boxes[None, :, 0]) & (low[:, None, 1] <= boxes[None, :, 3]) & (high[:, None, 1] >= boxes[None, :, 1]))
    near, whole = np.zeros(len(i), bool), np.zeros(len(polygons), bool)
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        out = (planes[b, :, 0] * middle[a, :1] + planes[b, :, 1] * middle[a, 1:] - planes[b, :, 2]).max(1)
        near[k : k + PAIRS] = out < reach[a]
        whole[a[out <= -reach[a]]] = True
    near &= ~whole[i]
    i, j = i[near], j[near]
    begin, many = np.searchsorted(i, np.arange(len(polygons))), np.bincount(i, minlength=len(polygons))
    left = ~whole[part]
    x, y, of = xy[left, 0], xy[left, 1], part[left]
    piece = of.copy()
    total = np.zeros(len(polygons))
    turn = 0
    while True:
        # pieces of parts that have met all their covers are done
        x, y, piece, area = _sized(x, y, piece)
        first, n, _ = _pieces(x, y, piece)
        owner = of_piece[piece[first]] if turn else piece[first]
        ended = many[owner] <= turn
        np.add.at(total, owner[ended], area[ended])
        stay = np.repeat(~ended, n)
        if not stay.any():
            return total
        owner, n = owner[~ended], n[~ended]
        x, y, piece = x[stay], y[stay], np.repeat(np.arange(len(owner)), n)
        cover = planes[j[begin[owner] + turn]]
        first, _, next_ = _pieces(x, y, piece)
        apart = np.zeros(len(owner), bool)
        for side in range(planes.shape[1]):
            a, b, c = np.repeat(cover[:, side], n, axis=0).T
            apart |= np.minimum.reduceat(a * x + b * y - c, first) >= 0
        gone = np.repeat(apart, n)
        kept = [(x[gone], y[gone], piece[gone], owner[piece[gone]])]
        x, y, piece = x[~gone], y[~gone], piece[~gone]
        for side in range(planes.shape[1]):
            if not len(piece):
                break
            a, b, c = cover[piece, side].T
            d = a * x + b * y - c
            _, _, next_ = _pieces(x, y, piece)
            beyond = _half(x, y, piece, -d, next_)
            kept.append((*beyond, owner[beyond[2]]))
            x, y, piece, _ = _sized(*_half(x, y, piece, d, next_))
        # pieces are numbered anew, those of one side after those of the last
        base, numbers = 0, []
        for part_ in kept:
            numbers.append(part_[2] + base)
            base += len(owner)
        x, y, piece, who = (np.concatenate(v) for v in ([k[0] for k in kept], [k[1] for k in kept], numbers, [k[3] for k in kept]))
        of_piece = np.zeros(base, int)
        of_piece[piece] = who
        turn += 1


def uncovered(parts: DataFrame, covers: DataFrame) -> DataFrame:
    """name and area: of each convex part (name, part) what is outside of all ``covers`` (edges), convex polygons.

    Parts are cut at the sides of square tiles, whose areas add up, and covers go to the tiles that their boxes meet: parts
    stream past the covers of one tile. A tile holds some hundreds of covers on the average, so it is small where they are dense.
    """
    ends = lambda c, of: F.transform(of, lambda p: p[c])
    box = lambda x, y: {"x_low": F.array_min(x), "y_low": F.array_min(y), "x_high": F.array_max(x), "y_high": F.array_max(y)}
    boxed = covers.select("edges").withColumns(box(ends("x1", "edges"), ends("y1", "edges")))
    n, side, x0, y0, x1, y1 = boxed.agg(F.count("*"), F.avg(F.greatest(F.col("x_high") - F.col("x_low"), F.col("y_high") - F.col("y_low"))), F.min("x_low"), F.min("y_low"), F.max("x_high"), F.max("y_high")).first()
    tile = max(min(2 * (side or 1.0), math.sqrt(max((x1 or 0) - (x0 or 0), 1e-6) * max((y1 or 0) - (y0 or 0), 1e-6) * COVERS / max(n, 1))), (side or 1.0) / 4, 1e-3)
    bins = lambda v: F.explode(F.sequence(F.floor(F.col(f"{v}_low") / tile), F.floor(F.col(f"{v}_high") / tile)))
    kind = parts.schema["name"].dataType.simpleString()
    flat = lambda of, *cs: F.flatten(F.transform(of, lambda p: F.array(*(p[c].cast("double") for c in cs))))
    held = boxed.withColumn("bx", bins("x")).withColumn("by", bins("y")).select("bx", "by", F.lit(0).alias("k"), F.lit(None).cast(kind).alias("name"), flat("edges", "x1", "y1").alias("v"))
    cut = parts.withColumns(box(ends("x", "part"), ends("y", "part"))).withColumn("bx", bins("x")).withColumn("by", bins("y"))
    plane = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    sides = F.array(plane(-1, 0, -F.col("bx") * tile), plane(1, 0, (F.col("bx") + 1) * tile), plane(0, -1, -F.col("by") * tile), plane(0, 1, (F.col("by") + 1) * tile))
    alone = (F.floor(F.col("x_low") / tile) == F.floor(F.col("x_high") / tile)) & (F.floor(F.col("y_low") / tile) == F.floor(F.col("y_high") / tile))
    streamed = cut.withColumn("part", F.when(alone, F.col("part")).otherwise(clipped(F.col("part"), sides))).where(F.size("part") > 2).select("bx", "by", F.lit(1).alias("k"), "name", flat("part", "x", "y").alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, rings, planes, boxes = None, [], None, None
        for f in frames:
            keys = f[["bx", "by", "k"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(f) else []
            for a, b in zip(starts, np.r_[starts[1:], len(f)] if len(f) else []):
                if tuple(keys[a, :2]) != tile:
                    tile, rings, planes = tuple(keys[a, :2]), [], None
                got = [np.asarray(v).reshape(-1, 2) for v in f["v"].iloc[a:b]]
                if keys[a, 2] == 0:
                    rings += [r for r in got if (np.hypot(*(np.roll(r, -1, 0) - r).T) > SHORT).sum() > 2]
                    continue
                if planes is None:
                    planes = np.zeros((len(rings), max(map(len, rings), default=1), 3))
                    boxes = np.array([[*r.min(0), *r.max(0)] for r in rings]).reshape(-1, 4)
                    for own, r in zip(planes, rings):
                        step = np.roll(r, -1, 0) - r
                        long = np.hypot(*step.T)
                        r, step, long = r[long > SHORT], step[long > SHORT], long[long > SHORT]
                        normal = np.c_[step[:, 1], -step[:, 0]] / long[:, None]
                        own[: len(r)] = np.c_[normal, (normal * r).sum(1)]
                        own[len(r) :] = own[0]
                for s in range(0, len(got), PARTS):
                    names = f["name"].iloc[a + s : min(a + s + PARTS, b)]
                    yield pd.DataFrame({"name": names, "area": _left_over(got[s : s + PARTS], planes, boxes)})

    tasks = 4 * max(parts.sparkSession.sparkContext.defaultParallelism, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = held.unionByName(streamed).repartition(tasks, "bx", "by").sortWithinPartitions("bx", "by", "k")
    return rows.mapInPandas(run, f"name {kind}, area double").groupBy("name").agg(F.sum("area").alias("area"))
