"""Areas of convex parts outside of covers, beside the overlay of all edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotweave.operators import convex, overlay, voronoi


def test_uncovered(spark):
    """Parts side by side, under capsules that overlap, lie within a part, cover one, share sides with one, or meet none."""
    rng = random.Random(7)
    parts = [(f"p{i}{j}", 10.0 * i, 10.0 * j) for i in range(10) for j in range(10)]
    frame = spark.createDataFrame(parts, "poly string, x double, y double").select("poly", convex.box(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10).alias("part"))
    rows = [(f"r{k}", rng.uniform(-5, 105), rng.uniform(-5, 105), rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(0.3, 4)) for k in range(40)]
    rows += [("dot", 15.0, 15.0, 0.0, 0.0, 2.0), ("same", 15.0, 15.0, 0.0, 0.0, 2.0), ("all", 55.0, 55.0, 20.0, 0.0, 9.0), ("far", 900.0, 900.0, 5.0, 0.0, 1.0)]
    roads = spark.createDataFrame(rows, "poly string, x double, y double, dx double, dy double, w double")
    roads = roads.select("poly", convex.edges(convex.capsule(F.col("x"), F.col("y"), F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), F.col("w"))).alias("edges"))
    square = spark.createDataFrame([("square", 30.0, 20.0)], "poly string, x double, y double").select("poly", convex.edges(convex.box(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 20)).alias("edges"))
    roads = roads.unionByName(square).persist()
    layers = frame.select(F.lit("own").alias("layer"), "poly", convex.edges(F.col("part")).alias("edges")).unionByName(roads.select(F.lit("road").alias("layer"), "poly", "edges"))
    want = {r.label: r.area for r in overlay.areas(overlay.boundary(overlay.faces(layers), overlay.own_label("own", "road"))).collect()}
    got = {r.name: r.area for r in convex.uncovered(frame.select(F.col("poly").alias("name"), "part"), roads).collect()}
    assert {k for k, v in got.items() if v > 1e-3} == {k for k, v in want.items() if v > 1e-3}
    assert got["p32"] == got["p33"] == got["p55"] == 0
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-3)
    assert roads.where(~convex.is_convex(F.col("edges"))).count() == 0


def test_convex(spark):
    rings = {"square": [(0, 0), (1, 0), (1, 1), (0, 1)], "clockwise": [(0, 0), (0, 1), (1, 1), (1, 0)], "dent": [(0, 0), (4, 0), (4, 4), (3, 1)], "star": [(math.cos(k * 4 * math.pi / 5), math.sin(k * 4 * math.pi / 5)) for k in range(5)]}
    rows = [(n, [(*map(float, r[k]), *map(float, r[(k + 1) % len(r)])) for k in range(len(r))]) for n, r in rings.items()]
    frame = spark.createDataFrame(rows, "n string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert {r.n for r in frame.where(convex.is_convex(F.col("edges"))).collect()} == {"square"}


def test_owned_areas_make_no_overlay(spark, monkeypatch):
    """Convex roads cut parts one by one; others still go through the overlay, with the same areas."""
    seg = spark.createDataFrame([("h", 10.0, 50.0, 90.0, 50.0), ("v", 50.0, 60.0, 50.0, 90.0)], "seg string, x1 double, y1 double, x2 double, y2 double")
    roads = seg.select(F.col("seg").alias("poly"), convex.edges(convex.capsule(*map(F.col, ("x1", "y1", "x2", "y2")), 3.0)).alias("edges"))
    turned = roads.withColumn("edges", F.transform(F.reverse("edges"), lambda e: F.struct(e["x2"].alias("x1"), e["y2"].alias("y1"), e["x1"].alias("x2"), e["y1"].alias("y2"))))
    areas = lambda r: {x.seg: x.area for x in voronoi.owned_areas(seg, (0.0, 0.0, 100.0, 100.0), 12.0, r).collect()}
    want = areas(turned)
    monkeypatch.setattr(voronoi.overlay, "faces", lambda *a: pytest.fail("all edges are overlaid"))
    assert areas(roads) == pytest.approx(want, abs=0.01)
