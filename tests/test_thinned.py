"""Points thinned tile by tile are those of one pass over all points."""

import random

from plotweave.operators import validate


def test_thinned_samples(spark):
    rng = random.Random(8)
    rows = [(f"s{rng.randint(0, 10**6)}", *(float(rng.randint(-400, 400)) for _ in range(4))) for _ in range(150)]
    rows += [("level", -300.0, 7.0, 300.0, 7.0), ("level too", -300.0, 7.0, 300.0, 7.0), ("upright", 31.0, -200.0, 31.0, 210.5), ("dot", 2.0, 2.0, 2.0, 2.0), ("short", 1.0, 1.0, 1.5, 2.0), ("none", None, 0.0, 1.0, 1.0)]
    seg = spark.createDataFrame(rows, "id string, x1 double, y1 double, x2 double, y2 double")
    for step in (5.0, 3.0):
        want = sorted(map(tuple, validate.thin_points(validate.sample_points(seg, step)).where("x IS NOT NULL").collect()))
        frame = validate.thinned_samples(seg, step)
        assert sorted(map(tuple, frame.select("id", "enum", "x", "y").collect())) == want
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
