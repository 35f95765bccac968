"""Cells: no frame of sites goes through the driver on its way to a join."""

import random

from plotweave.operators import convex, voronoi


def test_sites_are_not_broadcast(spark, monkeypatch):
    plans, settled = [], voronoi.settled
    monkeypatch.setattr(voronoi, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    rng = random.Random(2)
    sites = spark.createDataFrame([(k, float(rng.randint(0, 99)), float(rng.randint(0, 99))) for k in range(40)], "id long, x double, y double")
    cells = voronoi.cells(sites, (0.0, 0.0, 100.0, 100.0))
    plans.append(cells._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)  # else a join may become a broadcast while it runs
    assert abs(cells.agg({"id": "count"}).first()[0] - sites.select("x", "y").distinct().count()) == 0
    assert abs(cells.select(voronoi.F.sum(convex.area(voronoi.F.col("cell")))).first()[0] - 10_000) < 1e-3
