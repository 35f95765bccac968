"""The cell of a point, by plain arithmetic: nothing is sorted, so no comparison is interpreted row by row."""

import math

from plotweave.operators import lattice as lt


def test_assign_without_sorting(spark):
    g = lt.Lattice(0.0, 100.0, 10.0)
    rows = [(k, k * 7.31 % 90, k * 3.77 % 90) for k in range(300)] + [(300, 0.0, 95.0), (301, None, 5.0), (302, 2.0, None)]
    got = lt.assign(spark.createDataFrame(rows, "id long, x double, y double"), g).where("cell IS NOT NULL")
    assert "sort" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r.id: r.cell for r in got.collect()}
    assert set(found) == set(range(300))  # (0, 95) is on an edge that two cells share
    for k, x, y in rows[:300]:
        d = lambda r, c: math.hypot(x - c * g.step, y - (100.0 - r * 10.0 - c % 2 * 5.0))
        assert found[k] == "{}_{}".format(*min(((r, c) for r in range(-2, 13) for c in range(-2, 13)), key=lambda p: d(*p)))
