"""Neighbours and polygons where density and sizes are uneven."""

import random

import pytest
from pyspark.sql import functions as F

from plotweave.operators import near, polygons


def crowd(rng, n):
    """Half of the points in one place a millionth as wide as the whole, some of them twice."""
    dense = [(500.0 + rng.random() * 1e-3, 500.0 + rng.random() * 1e-3) for _ in range(n // 2)]
    return [(k, *p) for k, p in enumerate(dense + dense[:5] + [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(n // 2)] + [(0.0, 0.0), (1000.0, 1000.0)])]


def plain(queries, points, k, self_join, ties):
    out = set()
    for q, x, y in queries:
        d = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, r) for r, u, v in points if not self_join or r != q)
        out |= {(q, r) for t, r in d if t <= d[min(k, len(d)) - 1][0]} if ties else {(q, r) for _, r in d[:k]}
    return out


@pytest.mark.parametrize("k, self_join, ties", [(1, False, True), (4, True, False)])
def test_tree_beside_all_pairs(spark, k, self_join, ties):
    rng = random.Random(k)
    points = crowd(rng, 400)
    queries = points if self_join else [(k, rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for k in range(60)] + [(100 + k, 500.0005, 500.0 + k * 1e-5) for k in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double")
    got = near.nearest_by_tree(frame(queries), frame(points), k, self_join, ties, leaf=4)
    assert {(r.q_id, r.r_id) for r in got.collect()} == plain(queries, points, k, self_join, ties)


def test_crowded_bins_go_to_the_tree(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame(crowd(rng, 2000), "id long, x double, y double")
    called = []
    monkeypatch.setattr(near, "nearest_by_tree", lambda *a: called.append(a) or df)
    near.nearest(df, df, 4, self_join=True)
    assert called
    nodes, placed, _ = near.quadtree(df)
    fullest = placed.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0]
    assert fullest <= near.LEAF and placed.count() == df.count() and placed.select("id").distinct().count() == df.count()
    assert sum(n.count() for n in nodes) < df.count()


def test_large_polygon_among_small_ones(spark):
    ring = lambda x, y, s: [(x, y, x + s, y), (x + s, y, x + s, y + s), (x + s, y + s, x, y + s), (x, y + s, x, y)]
    small = [(k, ring(float(k % 50) * 2, float(k // 50) * 2, 1.0)) for k in range(1000)]
    df = spark.createDataFrame(small + [(-1, ring(-50_000.0, -50_000.0, 100_000.0))], "poly long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    filed, _, levels = polygons._filed(df, 1.0)
    assert filed.groupBy("poly").count().agg(F.max("count")).first()[0] <= 4 and levels == [0, 17]
    points = spark.createDataFrame([(k, (k % 100) + 0.5, (k // 100) + 0.5) for k in range(4000)], "id long, x double, y double")
    got = {(r.id, r.poly) for r in polygons.points_in_polygons(points, df, 1.0).collect()}
    assert got == {(k, -1) for k in range(4000)} | {(k, (k % 100) // 2 + (k // 100) // 2 * 50) for k in range(4000) if k % 100 % 2 == 0 and k // 100 % 2 == 0}
    seg = spark.createDataFrame([("a", 0.5, 0.5, 2.5, 0.5), ("b", -60_000.0, 0.0, -55_000.0, 0.0), ("c", 200.0, 200.0, 300.0, 300.0)], "seg string, x1 double, y1 double, x2 double, y2 double")
    assert {(r.seg, r.poly) for r in polygons.segments_in_polygons(seg, df, 1.0).collect()} == {("a", 0), ("a", 1), ("a", -1), ("c", -1)}
