"""Nearest segments against all pairs, and the parts of reproduction checks that no query shows."""

import math
import random

import pytest

from plotweave.operators import reproduce, segments


def test_nearest_segments(spark):
    rng = random.Random(1)
    seg = [(f"s{k}", *(float(rng.randint(-300, 300)) for _ in range(4))) for k in range(80)]
    seg += [("dot", 5.0, 5.0, 5.0, 5.0), ("up", 10.0, -900.0, 10.0, 900.0), ("far", 9000.0, 1.0, 9100.0, 2.0), ("twin", *seg[0][1:])]
    points = [(k, float(rng.randint(-400, 400)), float(rng.randint(-400, 400))) for k in range(120)] + [(500, 5.0, 5.0), (501, -7000.0, 30.0), (502, seg[0][1], seg[0][2])]

    def distance(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n, 0.0), 1.0) if n else 0.0
        return math.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1)))

    for size in (None, 3.0, 4000.0):
        got = segments.nearest_segments(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(seg, "seg string, x1 double, y1 double, x2 double, y2 double"), size).collect()
        assert {r.q_id for r in got} == {p[0] for p in points}
        for r in got:
            x, y = next(p[1:] for p in points if p[0] == r.q_id)
            all_ = {s[0]: distance(x, y, *s[1:]) for s in seg}
            assert abs(r.d - min(all_.values())) < 1e-9 and abs(all_[r.r_id] - r.d) < 1e-9
        tied = {r.r_id for r in got if r.q_id == 502}
        assert {"s0", "twin"} <= tied and all(r.tied for r in got if r.q_id == 502)


def test_drift():
    reproduce.require_no_drift({"a": 1, "b": 2}, {"headline": {"a": 1, "c": 3}}, ["headline"])
    with pytest.raises(ValueError):
        reproduce.require_no_drift({"a": 1}, {"headline": {"a": 2}})
    with pytest.raises(KeyError):
        reproduce.require_no_drift({}, {}, ["other"])


def test_cell_reproduction_without_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "cell string, m double")
    with pytest.raises(ValueError):
        reproduce.cell_reproduction(df, ["m"], df, 0, 0)
