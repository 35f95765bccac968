"""Segments cut by cells on Arrow batches: lengths add up, cells are those that a walk in small steps passes through."""

import math
import random

from plotweave.operators import lattice as lt


def test_cut_on_batches(spark):
    g, rng = lt.Lattice(0.0, 100.0, 10.0), random.Random(4)
    rows = [(str(k), *(rng.uniform(0, 90) for _ in range(4))) for k in range(60)] + [("up", 20.3, 5.0, 20.3, 60.0), ("place", 31.0, 42.0, 31.0, 42.0), ("null", None, 1.0, 2.0, 3.0)]
    cut = lt.cut_by_cells(spark.createDataFrame(rows, "seg string, x1 double, y1 double, x2 double, y2 double"), g)
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString() and cut.columns == ["seg", "x1", "y1", "x2", "y2", "cell", "part"]
    got = {}
    for r in cut.collect():
        got.setdefault(r.seg, {})[r.cell] = r.part
    assert set(got) == {r[0] for r in rows} - {"null"}
    for seg, x1, y1, x2, y2 in rows[:-1]:
        assert abs(sum(got[seg].values()) - math.hypot(x2 - x1, y2 - y1)) < 1e-6
        for k in range(0, 401):
            x, y = x1 + (x2 - x1) * k / 400, y1 + (y2 - y1) * k / 400
            near = min(((r, c) for r in range(-1, 12) for c in range(-1, 12)), key=lambda p: math.hypot(x - p[1] * g.step, y - (100.0 - p[0] * 10.0 - p[1] % 2 * 5.0)))
            assert "{}_{}".format(*near) in got[seg]
