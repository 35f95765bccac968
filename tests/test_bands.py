"""Bands whose pairs outgrow what is shuffled: many tasks, and totals without the pairs."""

import math
import random

from plotweave.operators import near, weights
from plotweave.plans import registry, spatial


def places(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randint(0, 200)), float(rng.randint(0, 200))) for k in range(300)] + [(300, 900.0, 900.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def test_pairs_are_dealt_to_many_tasks(spark):
    rows, p = places(spark)
    pairs = near.within(p, p, 30.0, self_join=True)
    assert sorted((r.q_id, r.r_id) for r in pairs.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and math.dist(a[1:], b[1:]) <= 30)
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_totals_without_pairs(spark):
    _, p = places(spark)
    w = weights.band_weights(p, 30.0)
    got = weights.band_totals(p, 30.0).first()
    assert (got.n_links, got.n_islands) == (w.count(), weights.islands(p, w).count())
    assert abs(got.weight - w.agg({"w": "sum"}).first()[0]) < 1e-9


def test_one_to_one_needs_no_band(spark, monkeypatch):
    monkeypatch.setattr(spatial.near, "within", None)
    assert registry.QUERIES["nearest_one_to_one"](spark, "/root/testdata/sf0.001").count() > 0
