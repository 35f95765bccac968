"""Blocks, training links and predictions beside plain computations."""

import numpy as np
import pytest

from plotweave.operators import crossval

from .test_spreg import dense


def crowd(seed, n):
    """Whole-number places, many equally far apart, half of them in a dense corner."""
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n)[:, None] < 0.5, rng.integers(0, 12, (n, 2)), rng.integers(0, 200, (n, 2))).astype(float)


def plain_links(xy, fold, k):
    out = set()
    for f in set(fold):
        train = [i for i in range(len(xy)) if fold[i] != f]
        for i in train:
            order = sorted((((xy[i] - xy[j]) ** 2).sum(), j) for j in train if j != i)
            out |= {(f, i, j) for _, j in order[:k]}
    return out


@pytest.mark.parametrize("by_place", [True, False])
def test_training_links(spark, by_place):
    """Folds by place leave many points at an edge with too few candidates; ids by turns hardly any."""
    xy = crowd(1, 220)
    fold = [("dense" if (p < 12).all() else "left" if p[0] < 100 else "right") if by_place else str(i % 4) for i, p in enumerate(xy)]
    df = spark.createDataFrame([(i, float(x), float(y), f) for i, ((x, y), f) in enumerate(zip(xy, fold))] + [(900, None, 1.0, "left"), (901, 1.0, 1.0, None)], "id long, x double, y double, fold string")
    got = crossval.training_links(df, 4).collect()
    assert {(r.fold, r.i, r.j) for r in got} == plain_links(xy, fold, 4) and len(got) == len({(r.fold, r.i, r.j) for r in got})
    assert {r.w for r in got} == {0.25}


def test_links_of_small_sets(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1.0, 0.0, "b"), (3, 5.0, 0.0, "b")], "id long, x double, y double, fold string")
    got = {(r.fold, r.i, r.j, r.w) for r in crossval.training_links(df, 3).collect()}
    assert got == {("a", 2, 3, 1.0), ("a", 3, 2, 1.0)}
    assert crossval.training_links(df.where("false"), 3).count() == 0


def test_blocks(spark):
    rng = np.random.default_rng(3)
    middle = np.array([(0, 0), (0, 90), (50, 40), (90, 0), (90, 90)], float)
    xy = np.concatenate([m + rng.normal(size=(40 + 20 * i, 2)) * 4 for i, m in enumerate(middle)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, None)], "id long, x double, y double")
    centres = crossval.kmeans_centres(df, 5)
    own = np.repeat(np.arange(5), [40, 60, 80, 100, 120])
    assert np.allclose(sorted(map(tuple, centres)), sorted(tuple(xy[own == b].mean(0)) for b in range(5)))
    got = {r.id: r.fold for r in crossval.spatial_blocks(df, 5).collect()}
    assert got.pop(999) is None
    plain = ((xy[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert got == {i: str(b) for i, b in enumerate(plain)}
    with pytest.raises(ValueError):
        crossval.kmeans_centres(df.limit(3), 5)


def test_predictions(spark):
    """Each fold fitted with dense matrices on its training rows alone."""
    rng = np.random.default_rng(5)
    xy, n, k = rng.uniform(0, 100, (150, 2)), 150, 5
    a, b = rng.normal(size=n), rng.normal(size=n) + xy[:, 0] / 50  # b explains little: in one fold rho starts at its bound
    y = 1 + 2 * a + 0.5 * b + 0.5 * np.sin(xy[:, 0] / 15) + rng.normal(size=n)
    fold = np.array([str(int(p[0] // 34)) for p in xy])
    rows = [(i, *map(float, xy[i]), float(y[i]), float(a[i]), float(b[i]), fold[i]) for i in range(n)] + [(500, 1.0, 1.0, None, 1.0, 1.0, "0"), (501, 1.0, 1.0, 1.0, float("nan"), 1.0, "0")]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double, a double, b double, fold string")
    found = crossval.cross_validate(df, "v", {"one": ["a"], "two": ["b"]}, k).persist()
    got = {(r.spec, r.id): r for r in found.collect()}
    assert len(got) == 2 * n
    errors = {s: {c: [] for c in ("trend", "recal", "ols", "mean")} for s in ("one", "two")}
    for spec, col in (("one", a), ("two", b)):
        for f in sorted(set(fold)):
            t, h = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = np.zeros((len(t), len(t)))
            for p, i in enumerate(t):
                d = ((xy[t] - xy[i]) ** 2).sum(1)
                d[p] = np.inf
                w[p, np.argsort(d)[:k]] = 1 / k
            x = np.column_stack([np.ones(n), col])
            coef, _, _, _ = dense(w, x[t], y[t], "sarar")
            trend, ols = x @ coef[:2], x @ np.linalg.lstsq(x[t], y[t], rcond=None)[0]
            recal = trend + (y[t] - trend[t]).mean()
            for i in h:
                r = got[spec, i]
                assert (r.pred_trend, r.pred_recal, r.pred_ols, r.pred_mean) == pytest.approx((trend[i], recal[i], ols[i], y[t].mean()), rel=1e-4, abs=1e-4)
                assert r.fold == f and r.lambda_lag == pytest.approx(coef[2], rel=1e-3, abs=1e-4)
                for c, v in zip(errors[spec], (trend[i], recal[i], ols[i], y[t].mean())):
                    errors[spec][c].append((y[i] - v) ** 2)
    for r in crossval.scores(found).collect():
        assert r.n_folds == 3 and r.n_pred == n
        for c, e in errors[r.spec].items():
            assert r[f"rmse_{c}"] == pytest.approx(np.mean(e) ** 0.5, rel=1e-4)
    with pytest.raises(ValueError):
        crossval.cross_validate(df, "v", {"one": ["a"], "two": ["a", "b"]}, k)
