"""Convex clipping, Voronoi cells and overlays beside rasters, plain clipping and known areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.operators import convex, overlay, voronoi


def edges(ring):
    return [(float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]


def layers(spark, rows):
    return spark.createDataFrame([(layer, str(k), edges(ring)) for k, (layer, ring) in enumerate(rows)], "layer string, poly string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def area_of(bound):
    return {r.label: r.area for r in overlay.areas(bound).collect()}


def test_known_overlays(spark):
    two = layers(spark, [("a", square(0, 0, 10)), ("b", square(5, 5, 10)), ("b", square(30, 0, 2))])
    found = overlay.faces(two)
    for label, want in ((overlay.union_label("a", "b"), 179.0), (overlay.intersection_label("a", "b"), 25.0), (overlay.difference_label("a", "b"), 75.0), (overlay.difference_label("b", "a"), 79.0)):
        assert area_of(overlay.boundary(found, label))[True] == pytest.approx(want, abs=1e-6)
    own = area_of(overlay.boundary(overlay.faces(layers(spark, [("a", square(0, 0, 10)), ("a", square(10, 0, 10)), ("b", square(8, 2, 4))])), overlay.own_label("a", "b")))
    assert own == {"0": pytest.approx(92.0, abs=1e-6), "1": pytest.approx(92.0, abs=1e-6)}


def test_edges_that_lie_on_each_other_and_corners_that_touch(spark):
    same = layers(spark, [("a", square(0, 0, 4)), ("a", square(0, 0, 4)), ("a", square(4, 0, 4)), ("a", square(2, 0, 4)), ("a", square(8, 4, 2))])
    bound = overlay.boundary(overlay.faces(same), overlay.union_label("a"))
    assert area_of(bound)[True] == pytest.approx(36.0, abs=1e-6)
    got = {r.ring: r.area for r in overlay.rings(bound).collect()}
    assert sorted(got.values()) == pytest.approx([4.0, 32.0], abs=1e-6)


def test_rings_and_holes(spark):
    frame = layers(spark, [("a", [(0, 0), (20, 0), (20, 3), (0, 3)]), ("a", [(0, 17), (20, 17), (20, 20), (0, 20)]), ("a", [(0, 0), (3, 0), (3, 20), (0, 20)]), ("a", [(17, 0), (20, 0), (20, 20), (17, 20)]), ("a", square(9, 9, 2)), ("a", square(40, 0, 1))])
    bound = overlay.boundary(overlay.faces(frame), overlay.union_label("a"))
    assert sorted({round(r.area, 6) for r in overlay.rings(bound).collect()}) == [-196.0, 1.0, 4.0, 400.0]
    assert area_of(overlay.footprint(frame, 0.0))[True] == pytest.approx(401.0, abs=1e-3)


@pytest.mark.parametrize("width", [3.0, -2.0])
def test_buffers_of_a_square(spark, width):
    got = area_of(overlay.buffered(layers(spark, [("a", square(0, 0, 20)), ("a", square(10, 0, 20))]), width, quarter=6))[True]
    corner = 0.5 * 9 * 24 * math.sin(2 * math.pi / 24)  # the four round corners, as chords
    assert got == pytest.approx(600 + 2 * 3 * 50 + corner if width > 0 else 26 * 16, rel=1e-5)


def covered(ring, x, y):
    odd = np.zeros(x.shape, bool)
    for a, b, c, d in edges(ring):
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= ((b > y) != (d > y)) & (x < a + (c - a) * (y - b) / (d - b))
    return odd


def test_random_polygons_beside_a_raster(spark):
    rng = random.Random(4)
    rows = []
    for k in range(24):
        cx, cy, n = rng.uniform(0, 100), rng.uniform(0, 100), rng.randint(3, 7)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        rows.append(("ab"[k % 2], [(cx + rng.uniform(4, 25) * math.cos(t), cy + rng.uniform(4, 25) * math.sin(t)) for t in turns]))
    x, y = np.meshgrid(np.arange(-30, 130, 0.1) + 0.05, np.arange(-30, 130, 0.1) + 0.05)
    a = np.any([covered(r, x, y) for layer, r in rows if layer == "a"], axis=0)
    b = np.any([covered(r, x, y) for layer, r in rows if layer == "b"], axis=0)
    found = overlay.faces(layers(spark, rows))
    for label, want in ((overlay.union_label("a", "b"), a | b), (overlay.intersection_label("a", "b"), a & b), (overlay.difference_label("a", "b"), a & ~b)):
        bound = overlay.boundary(found, label)
        assert area_of(bound)[True] == pytest.approx(want.sum() * 0.01, rel=4e-3)
        joined = overlay.rings(bound)
        assert joined.count() == bound.count()
        assert sum({r.ring: r.area for r in joined.collect()}.values()) == pytest.approx(want.sum() * 0.01, rel=4e-3)


def plain_cells(sites, bounds):
    x0, y0, x1, y1 = bounds
    out = []
    for k, (px, py) in enumerate(sites):
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        for j, (qx, qy) in enumerate(sites):
            if j == k:
                continue
            a, b = qx - px, qy - py
            s = [a * (u - (px + qx) / 2) + b * (v - (py + qy) / 2) for u, v in ring]
            new = []
            for i, (u, v) in enumerate(ring):
                m = (i + 1) % len(ring)
                if s[i] <= 0:
                    new.append((u, v))
                if s[i] * s[m] < 0:
                    t = s[i] / (s[i] - s[m])
                    new.append((u + t * (ring[m][0] - u), v + t * (ring[m][1] - v)))
            ring = new
        out.append(abs(sum(a * d - c * b for a, b, c, d in edges(ring))) / 2 if ring else 0.0)
    return out


@pytest.mark.parametrize("first", [3, 24])
def test_voronoi_cells(spark, first):
    rng = random.Random(9)
    sites = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(60)] + [(50 + rng.gauss(0, 0.3), 50 + rng.gauss(0, 0.3)) for _ in range(80)]
    sites += [(90 + 4 * math.cos(k / 5), 10 + 4 * math.sin(k / 5)) for k in range(31)] + [(90.0, 10.0)]  # a ring around its middle: a cell of many sides
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(sites)] + [(1000, *sites[0])], "id long, x double, y double")
    got = {r.id: r.a for r in voronoi.cells(df, (0, 0, 100, 100), first).select("id", convex.area(F.col("cell")).alias("a")).collect()}
    assert sorted(got) == list(range(len(sites)))
    assert [got[k] for k in range(len(sites))] == pytest.approx(plain_cells(sites, (0, 0, 100, 100)), abs=1e-6)
    assert sum(got.values()) == pytest.approx(10_000, abs=1e-6)


def test_few_sites(spark):
    one = spark.createDataFrame([(1, 2.0, 3.0)], "id long, x double, y double")
    assert voronoi.cells(one, (0, 0, 10, 10)).select(convex.area(F.col("cell")).alias("a")).first().a == pytest.approx(100.0)
    assert voronoi.cells(one.limit(0), (0, 0, 10, 10)).collect() == []


def test_owned_parts(spark):
    seg = spark.createDataFrame([("h", 10.0, 50.0, 90.0, 50.0), ("v", 50.0, 60.0, 50.0, 90.0)], "seg string, x1 double, y1 double, x2 double, y2 double")
    points = [(f"h{k}", "h", 10.0 + 5 * k, 50.0) for k in range(17)] + [(f"v{k}", "v", 50.0, 60.0 + 5 * k) for k in range(7)]
    parts = voronoi.owned_parts(seg, spark.createDataFrame(points, "id string, seg string, x double, y double"), (0, 0, 100, 100), 12.0)
    got = {r.seg: r.a for r in parts.groupBy("seg").agg(F.sum(convex.area(F.col("part"))).alias("a")).collect()}
    x, y = np.meshgrid(np.arange(0, 100, 0.1) + 0.05, np.arange(0, 100, 0.1) + 0.05)
    near = np.argmin([(x - px) ** 2 + (y - py) ** 2 for _, _, px, py in points], axis=0)
    owner = np.array([s == "h" for _, s, *_ in points])[near]
    at_h = np.hypot(x - np.clip(x, 10, 90), y - 50) <= 12
    at_v = np.hypot(x - 50, y - np.clip(y, 60, 90)) <= 12
    assert got["h"] == pytest.approx((owner & at_h).sum() * 0.01, rel=0.01)
    assert got["v"] == pytest.approx((~owner & at_v).sum() * 0.01, rel=0.01)
