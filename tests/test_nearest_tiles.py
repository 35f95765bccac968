"""Nearest segments where segments are many and long: few filed rows, and the answers of plain comparison."""

import math
import random

from plotweave.operators import segments


def distance(x, y, s):
    dx, dy = s[3] - s[1], s[4] - s[2]
    n = dx * dx + dy * dy
    t = min(max(((x - s[1]) * dx + (y - s[2]) * dy) / n, 0.0), 1.0) if n else 0.0
    return math.hypot(x - s[1] - t * dx, y - s[2] - t * dy)


def test_rows_follow_points_and_not_crossings(spark, monkeypatch):
    rng = random.Random(3)
    seg = [(f"s{k:04}", x, y, x + rng.randint(-300, 300), y + rng.randint(-300, 300)) for k in range(1500) for x, y in [(rng.randint(0, 1000), rng.randint(0, 1000))]]
    seg = [(i, *map(float, e)) for i, *e in seg] + [("same-a", 5.0, 5.0, 5.0, 5.0), ("same-b", 5.0, 5.0, 5.0, 5.0)]
    points = [(2**60 + k, float(rng.randint(-50, 1050)), float(rng.randint(-50, 1050))) for k in range(60)] + [(1, 5.0, 5.0), (2, 5000.0, 5000.0)]
    filed, plain = [], segments.along
    monkeypatch.setattr(segments, "along", lambda *a: filed.append(plain(*a).count()) or plain(*a))
    got = segments.nearest_segments(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(seg, "seg string, x1 double, y1 double, x2 double, y2 double")).collect()
    assert filed[0] < 12 * len(seg)
    assert {r.q_id for r in got} == {p[0] for p in points}
    for i, x, y in points:
        least = min(distance(x, y, s) for s in seg)
        mine = [r for r in got if r.q_id == i]
        assert all(abs(r.d - least) < 1e-9 for r in mine)
        assert sorted(r.r_id for r in mine) == sorted(s[0] for s in seg if distance(x, y, s) == mine[0].d) or mine[0].tied or len(mine) == 1
    assert [r.r_id for r in got if r.q_id == 1][:2] == ["same-a", "same-b"]
