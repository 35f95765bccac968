"""The blocked solve beside numpy."""

import os

import numpy as np
import pandas as pd
import pytest

from plotweave.operators import graph, solve
from plotweave.plans import registry


def plain(cost, r, gamma, beta, steps, d0):
    f = np.where(np.isfinite(cost), (np.where(np.isfinite(cost), cost, 0) + d0) ** -beta, 0)
    np.fill_diagonal(f, 0)
    a = r.copy()
    for _ in range(steps):
        before, w = a, gamma * a + r
        a = w * (f @ w)
        a = a * (r.sum() / a.sum())
    return a, np.abs(a - before).sum() / r.sum()


@pytest.mark.parametrize("size, chain, steps", [(4, 3, 7), (16, 2, 4)])
def test_masses(spark, size, chain, steps):
    """Several blocks, a node without ways, ways to a node without capacity; more steps than a chain."""
    rng = np.random.default_rng(2)
    n = 13
    cost = rng.integers(1, 60, (n, n)).astype(float)
    cost[rng.random((n, n)) < 0.3] = np.inf
    cost[5], cost[:, 5] = np.inf, np.inf
    r = rng.integers(1, 9, n).astype(float)
    paths = [(f"n{i:02}", f"n{j:02}", cost[i, j]) for i in range(n) for j in range(n) if i == j or np.isfinite(cost[i, j])]
    paths = spark.createDataFrame([(a, b, 0.0 if a == b else float(c)) for a, b, c in paths] + [("n01", "zz", 1.0)], "source string, node string, cost double")
    capacity = spark.createDataFrame([(f"n{i:02}", float(r[i])) for i in range(n)] + [(None, 3.0)], "node string, r double")
    runs = [(1.0, 2.0), (0.0, 2.0), (2.0, 0.5)]
    masses = solve.evolve_grid(paths, capacity, runs, steps, 10.0, size, chain).persist()
    got = {(x.gamma, x.beta, x.node): x.mass for x in masses.collect()}
    norms = {(x.gamma, x.beta): x for x in solve.step_norms(masses).collect()}
    assert len(got) == n * len(runs)
    for gamma, beta in runs:
        a, norm = plain(cost, r, gamma, beta, steps, 10.0)
        assert [got[gamma, beta, f"n{i:02}"] for i in range(n)] == pytest.approx(list(a), rel=1e-9)
        assert (norms[gamma, beta].nodes, norms[gamma, beta].norm) == (n, pytest.approx(norm, abs=1e-9))
    one = graph.evolve(graph.decay_kernel(paths, 2.0, 10.0), capacity.where("node IS NOT NULL"), 1.0, 2)
    two = solve.evolve_grid(paths, capacity, [(1.0, 2.0)], 2, 10.0, size, chain)
    assert {x.node: x.mass for x in two.collect()} == pytest.approx({x.node: x.mass for x in one.collect()})


def test_empty(spark):
    paths, capacity = spark.createDataFrame([], "source long, node long, cost double"), spark.createDataFrame([], "node long, r double")
    assert solve.evolve_grid(paths, capacity, [(1.0, 2.0)], 3).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_suppliers(spark):
    """The whole query, 200 substitutions, from the tables: ways by Floyd and Warshall, masses by numpy."""
    lines, orders = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    met = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    customers, suppliers = sorted(met.o_custkey.unique()), sorted(lines.l_suppkey.unique())
    n, at = len(customers) + len(suppliers), {k: i for i, k in enumerate([("c", c) for c in customers] + [("s", s) for s in suppliers])}
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for c, s, q in zip(met.o_custkey, met.l_suppkey, met.l_quantity.astype(float)):
        i, j = at["c", c], at["s", s]
        d[i, j] = d[j, i] = min(d[i, j], q)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    d = d[len(customers) :, len(customers) :]
    r, area = (lines.groupby("l_suppkey").l_partkey.agg(f).loc[suppliers].to_numpy(float) for f in ("size", "nunique"))
    got = {(x.gamma, x.beta, x.node - 10**12): x for x in registry.QUERIES["fixed_point"](spark, SF).collect()}
    assert len(got) == 6 * len(suppliers)
    for gamma in (1.0, 0.0):
        for beta in (1.0, 2.0, 3.0):
            a, norm = plain(d, r, gamma, beta, 200, 5000.0)
            rows = [got[gamma, beta, s] for s in suppliers]
            assert [x.mass for x in rows] == pytest.approx(list(a), rel=1e-7, abs=1e-9)
            assert [x.density for x in rows] == pytest.approx(list(a / area), rel=1e-7, abs=1e-9)
            assert rows[0].norm == pytest.approx(norm, abs=1e-9)
