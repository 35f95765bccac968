"""Spatial models beside the same estimators with dense matrices, and beside known parameters."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from plotweave.operators import spreg, stats


def world(seed, n, lam, rho, k=6):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 10, (n, 2))
    d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :k]
    w = np.zeros((n, n))
    np.put_along_axis(w, near, 1 / k, 1)
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n) + xy[:, 0]])
    u = np.linalg.solve(np.eye(n) - rho * w, rng.normal(size=n) * (0.3 + 0.1 * xy[:, 0]))
    y = np.linalg.solve(np.eye(n) - lam * w, x @ [1.0, 2.0, -0.5] + u)
    return w, x, y


def frames(spark, jobs):
    rows = [(job, i, float(y[i]), float(x[i, 1]), float(x[i, 2])) for job, (w, x, y) in jobs.items() for i in range(len(y))]
    links = [(job, int(i), int(j), float(w[i, j])) for job, (w, x, y) in jobs.items() for i, j in np.argwhere(w)]
    return spark.createDataFrame(rows, "job string, id long, y double, a double, b double"), spark.createDataFrame(links, "job string, i long, j long, w double")


def dense(w, x, y, model):
    """Coefficients, their errors, rho and its error, with every matrix written out."""
    n = len(y)
    is_lag, is_error = model in ("sar", "sarar"), model in ("sem", "sarar")
    z = np.column_stack([x, w @ y]) if is_lag else x
    h = np.column_stack([x, (w @ x)[:, 1:], (w @ w @ x)[:, 1:]])
    a1, a2 = w.T @ w - np.diag((w**2).sum(0)), w

    def iv(y, z, h):
        zh = h @ np.linalg.lstsq(h, z, rcond=None)[0]
        return np.linalg.solve(zh.T @ z, zh.T @ y)

    def search(u, weight):
        wu = w @ u
        def loss(r):
            e = u - r * wu
            m = np.array([e @ a1 @ e, e @ a2 @ e]) / n
            return m @ weight @ m
        grid = np.linspace(-0.9, 0.9, 361)
        best = grid[np.argmin([loss(r) for r in grid])]
        step = 5e-3
        while step > 1e-9:
            best = min((max(best - step, -spreg.BOUND), best, min(best + step, spreg.BOUND)), key=loss)
            step *= 0.5 if best == min((max(best - step, -spreg.BOUND), best, min(best + step, spreg.BOUND)), key=loss) else 1
        return best

    def covariances(b, rho):
        u = y - z @ b
        e, zs = u - rho * w @ u, z - rho * w @ z
        hh = h if is_lag else zs
        s = np.diag(e**2)
        q1, q2 = hh.T @ hh / n, hh.T @ zs / n
        p = np.linalg.inv(q1) @ q2 @ np.linalg.inv(q2.T @ np.linalg.inv(q1) @ q2)
        t = hh @ p
        a = [t @ (-(zs.T @ (m + m.T) @ e) / n) for m in (a1, a2)]
        psi = np.array([[np.trace((r + r.T) @ s @ (c + c.T) @ s) / (2 * n) + ar @ s @ ac / n for c, ac in zip((a1, a2), a)] for r, ar in zip((a1, a2), a)])
        return t.T @ s @ t / n**2, psi

    b = iv(y, z, h if is_lag else x)
    rho = rho_se = None
    if is_error:
        rho = search(y - z @ b, np.eye(2))
        zs = z - rho * w @ z
        b = iv(y - rho * w @ y, zs, h if is_lag else zs)
        rho = search(y - z @ b, np.linalg.inv(covariances(b, rho)[1]))
    cov, psi = covariances(b, rho or 0.0)
    if is_error:
        u = y - z @ b
        g = lambda r: np.array([(u - r * w @ u) @ m @ (u - r * w @ u) for m in (a1, a2)]) / n
        slope = (g(rho + 1e-5) - g(rho - 1e-5)) / 2e-5
        rho_se = (slope @ np.linalg.inv(psi) @ slope * n) ** -0.5
    return b, np.sqrt(np.diag(cov)), rho, rho_se


@pytest.mark.parametrize("model", spreg.MODELS)
def test_beside_dense_matrices(spark, model):
    jobs = {"one": world(1, 120, 0.3, 0.4), "two": world(2, 90, 0.0, 0.6, 4)}
    rows, links = frames(spark, jobs)
    got = {}
    for r in spreg.fit_jobs(rows, links, "y", ["a", "b"], model).collect():
        got.setdefault(r.job, {})[r.term] = r
    for job, (w, x, y) in jobs.items():
        b, se, rho, rho_se = dense(w, x, y, model)
        names = ["const", "a", "b", "lambda_lag"][: len(b)]
        assert [got[job][t].estimate for t in names] == pytest.approx(list(b), rel=1e-4, abs=1e-5)
        assert [got[job][t].se for t in names] == pytest.approx(list(se), rel=1e-4)
        assert ("rho_error" in got[job]) == (rho is not None) and got[job]["const"].n == len(y)
        if rho is not None:
            assert (got[job]["rho_error"].estimate, got[job]["rho_error"].se) == (pytest.approx(rho, abs=1e-5), pytest.approx(rho_se, rel=1e-3))


def test_known_parameters_and_selection(spark):
    jobs = {"sarar": world(3, 900, 0.4, 0.5), "none": world(4, 900, 0.0, 0.0), "lag": world(5, 900, 0.5, 0.0), "error": world(6, 900, 0.0, 0.6)}
    rows, links = frames(spark, jobs)
    f = spreg.fit_all(rows.where("job = 'sarar'"), links, "y", ["a", "b"])["sarar"]
    assert abs(f.rho - 0.5) < 2 * f.rho_se < 0.4
    errors = np.sqrt(np.diag(f.cov))
    assert all(abs(f.coef - [1.0, 2.0, -0.5, 0.4]) < 3 * errors)
    chosen = {r.job: r.model for r in spreg.fit_jobs(rows, links, "y", ["a", "b"], "selected").collect()}
    assert chosen["error"] in ("sem", "sarar") and chosen["lag"] in ("sar", "sarar")
    table = spreg.lagged(rows, links, "y", ["a", "b"])
    known = spreg.moments(table, 3)
    picked = {r.job: r for r in spreg.select_models(spark, known, spreg._trace_terms(links, list(known))).collect()}
    for job in jobs:
        plain = stats.lm_tests(rows.where(F.col("job") == job), "y", ["a", "b"], links.where(F.col("job") == job))
        assert [picked[job][c] for c in plain] == pytest.approx(list(plain.values()), rel=1e-6)
        assert picked[job].model == chosen[job]
    with pytest.raises(ValueError):
        spreg.fit_jobs(rows, links, "y", ["a"], "probit")
