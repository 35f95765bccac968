"""Operators whose queries have no SQL, beside plain computations of the same."""

import math
import struct

import numpy as np
import pytest
import xxhash

from plotweave.functions import tests as probabilities
from plotweave.operators import graph, validate, variants

MASK = (1 << 64) - 1


def hashed(seed: int, key: int) -> int:
    """xxhash64(lit(seed), key) of an int and a long, each hashed with the last hash as its seed."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", key), first & MASK)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def test_folds(spark):
    df = spark.range(0, 500, 1, 7)
    got = {r.id: r.fold for r in variants.folds(df, "id", 10, 43).collect()}
    assert got == {k: signed(hashed(43, k)) % 10 for k in range(500)}


def test_jitter(spark):
    rows = [(k, float(k // 2 if k < 40 else 1000 + k), 5.0) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: (r.x, r.y) for r in validate.jitter(df, "x", "y", "id").collect()}
    u = lambda seed, k: signed(hashed(seed, k)) % (1 << 30) / (1 << 30)
    for k, x, y in rows:
        angle, r = 2 * math.pi * u(1, k), math.sqrt(u(2, k)) * 0.5
        assert got[k] == (pytest.approx((x + r * math.cos(angle), y + r * math.sin(angle)), abs=1e-9) if k < 40 else (x, y))
        assert math.hypot(got[k][0] - x, got[k][1] - y) <= 0.5
    assert len(set(got.values())) == 60


@pytest.mark.parametrize("gamma", [0.0, 2.0])
def test_fixed_point(spark, gamma):
    n, steps = 6, 4
    rng = np.random.default_rng(5)
    f = rng.random((n, n))
    np.fill_diagonal(f, 0)
    r = rng.random(n) + 0.5
    kernel = spark.createDataFrame([(i, j, float(f[i, j])) for i in range(n) for j in range(n) if i != j], "i long, j long, f double")
    capacity = spark.createDataFrame([(i, float(r[i])) for i in range(n)], "node long, r double")
    got = {x.node: x.mass for x in graph.evolve(kernel, capacity, gamma, steps).collect()}
    a = r.copy()
    for _ in range(steps):
        w = gamma * a + r
        a = w * (f @ w)
        a *= r.sum() / a.sum()
    assert [got[i] for i in range(n)] == pytest.approx(list(a))


@pytest.mark.parametrize("r, n", [(0.1, 12), (-0.55, 30), (0.9, 5), (0.02, 400), (0.3, 3)])
def test_correlation_p(r, n):
    """The tails of t by Simpson's rule over its density."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, t, 20001)
    y = scale * (1 + x * x / df) ** (-(df + 1) / 2)
    inner = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert float(probabilities.correlation_p(r, n)) == pytest.approx(1 - 2 * inner, rel=1e-6, abs=1e-10)


def test_centralities(spark):
    """A path of four with a branch: 0-1-2-3 and 1-4, each way of cost one."""
    ways = [(0, 1), (1, 2), (2, 3), (1, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in ways], "a long, b long, cost double")
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    got = {r.node: r for r in graph.centralities(edges, nodes).collect()}
    between = {0: 0, 1: 5, 2: 3, 3: 0, 4: 0}
    assert set(got) == set(between)
    # Ordered pairs count, so each way through counts twice.
    assert {k: r.betweenness for k, r in got.items()} == {k: pytest.approx(2 * v) for k, v in between.items()}
    assert {k: r.closeness for k, r in got.items()} == {k: pytest.approx(4 / far) for k, far in {0: 8, 1: 5, 2: 6, 3: 9, 4: 8}.items()}
    assert {k: r.degree for k, r in got.items()} == {0: 1, 1: 3, 2: 2, 3: 1, 4: 1}
