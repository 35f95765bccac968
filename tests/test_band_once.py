"""A band of points with themselves: each two meet once, so no point is spread over all bins around it."""

import math
import random

from plotweave.operators import near


def test_self_join_spreads_no_point_around(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, rng.uniform(-100, 100), rng.uniform(-100, 100)) for k in range(250)] + [(250, 0.0, 0.0), (251, 0.0, 0.0), (252, 30.0, 0.0), (253, -30.0, -30.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    apart = sorted((r.q_id, r.r_id, r.d) for r in near.within(p, p.select("*"), 30.0, self_join=True).collect())
    monkeypatch.setattr(near, "_around", None)
    got = sorted((r.q_id, r.r_id, r.d) for r in near.within(p, p, 30.0, self_join=True).collect())
    assert got == apart and [g[:2] for g in got] == sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and math.dist(a[1:], b[1:]) <= 30)
