"""Spatial lag and error models by two-stage least squares and weighted moments, from sums over rows and pairs.

A fit never sees its rows: the lags W, WW and WWW come from joins with the links, one grouping gives the products of all
columns, and whatever an estimator does with vectors is done with their coordinates in these columns. The covariance of
the moments needs squared residuals, so each of its two evaluations is one more pass over the rows and over the pairs that
have a neighbour in common. The driver holds a few small matrices for each job.

Parameters: ``lam`` belongs to the lagged value, ``rho`` to the error. Errors are robust to heteroskedasticity (Arraiz,
Drukker, Kelejian and Prucha 2010).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tests
from .lineage import settled
from .stats import lm_rule

MODELS = ("ols", "sar", "sem", "sarar")
BOUND = 0.9
#: Where the search for rho starts: of equally good values the nearest to it is taken.
START = 0.2
RESULT = "job string, model string, n long, term string, estimate double, se double, p double"


@dataclasses.dataclass
class Moments:
    """A job's products: ``gram`` of the columns, and ``diag``, the same weighted with the diagonal of W'W. k regressors, the constant included."""

    k: int
    n: int
    gram: np.ndarray
    diag: np.ndarray

    def units(self, *columns: int) -> np.ndarray:
        return np.eye(len(self.gram))[:, list(columns)]

    # Columns: x, Wx and WWx, k each, then y, Wy, WWy and WWWy.
    def x(self, lags: int = 0) -> np.ndarray:
        return self.units(*range(lags * self.k, (lags + 1) * self.k))

    def y(self, lags: int = 0) -> np.ndarray:
        return self.units(3 * self.k + lags)

    def z(self, lagged: bool, lags: int = 0) -> np.ndarray:
        """Regressors with ``lags`` lags: x, and Wy in lag models."""
        return np.hstack([self.x(lags), self.y(lags + 1)]) if lagged else self.x(lags)

    def part(self, xs: Sequence[int]) -> Moments:
        """The moments with the constant and these of the regressors (from 0) alone."""
        own = [0, *(x + 1 for x in xs)]
        at = np.ix_(*[[lag * self.k + i for lag in range(3) for i in own] + [3 * self.k + i for i in range(4)]] * 2)
        return Moments(len(own), self.n, self.gram[at], self.diag[at])

    def instruments(self) -> np.ndarray:
        """x, Wx and WWx without what depends on columns before it, as the lag of a constant does under row standardisation."""
        every, keep = np.hstack([self.x(0), self.x(1), self.x(2)]), np.zeros((len(self.gram), 0))
        for c in every.T:
            rest = c
            for _ in range(2 * (keep.shape[1] > 0)):  # twice, as the first projection leaves rounding behind
                own = self.gram @ keep
                rest = rest - keep @ np.linalg.lstsq(keep.T @ own, own.T @ rest, rcond=None)[0]
            if rest @ self.gram @ rest > 1e-10 * max(c @ self.gram @ c, 1e-300):
                keep = np.column_stack([keep, c])
        return keep


def lagged(rows: DataFrame, links: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """job, id, c0, c1, ...: the columns that ``Moments`` names; and d, the diagonal of W'W. A row without neighbours has lags of 0.

    Links without a job serve all jobs: an id's values of all jobs stand in one row then, and each link is met once a step.
    """
    k = len(xs) + 1
    first = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    base = settled(rows.select("job", "id", *(c.alias(f"c{i}") for i, c in enumerate(first)), F.col(y).cast("double").alias(f"c{3 * k}")))
    shared = "job" not in links.columns
    names = sorted(r[0] for r in base.select("job").distinct().collect()) if shared else []
    key, tags = ([], [f"_{n}" for n in range(len(names))]) if shared else (["job"], [""])
    if shared:
        own = lambda c, name: F.max(F.when(F.col("job") == name, F.col(c)))
        base = settled(base.groupBy("id").agg(*(own(f"c{i}", name).alias(f"c{i}{tag}") for i in (*range(k), 3 * k) for tag, name in zip(tags, names))))
    out = now = base
    for step in (1, 2, 3):
        xcols = [f"c{(step - 1) * k + i}" for i in range(k)] if step < 3 else []
        cols = [*xcols, f"c{3 * k + step - 1}"]
        to = [f"c{step * k + i}" for i in range(len(xcols))] + [f"c{3 * k + step}"]
        met = links.join(now.select(*key, F.col("id").alias("j"), *(f"{c}{tag}" for c in cols for tag in tags)), [*key, "j"])
        now = settled(met.groupBy(*key, F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(f"{c}{tag}")).alias(f"{t}{tag}") for c, t in zip(cols, to) for tag in tags)))
        out = out.join(now, [*key, "id"], "left")
    diag = links.groupBy(*key, F.col("j").alias("id")).agg(F.sum(F.col("w") * F.col("w")).alias("d"))
    out = out.join(diag, [*key, "id"], "left")
    if shared:
        each = (F.struct(F.lit(name).alias("job"), *(F.col(f"c{i}{tag}").alias(f"c{i}") for i in range(3 * k + 4))) for tag, name in zip(tags, names))
        out = out.select("id", "d", F.inline(F.array(*each))).where("c0 IS NOT NULL") if names else rows.sparkSession.createDataFrame([], f"job string, id {dict(base.dtypes)['id']}, d double, " + ", ".join(f"c{i} double" for i in range(3 * k + 4)))
    return settled(out.select("job", "id", *(F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(3 * k + 4)), F.coalesce("d", F.lit(0.0)).alias("d")))


def products(df: DataFrame, columns: Sequence[str], weights: dict[str, F.Column]) -> dict[str, tuple[int, dict[str, np.ndarray]]]:
    """For each job its rows, and for each weight the matrix of weighted sums of products."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"{name}_{k}") for name, w in weights.items() for k, (a, b) in enumerate(pairs)]
    out = {}
    for r in df.groupBy("job").agg(F.count("*").alias("n"), *sums).collect():
        out[r["job"]] = (r["n"], {name: np.zeros((len(columns),) * 2) for name in weights})
        for name, m in out[r["job"]][1].items():
            for k, (a, b) in enumerate(pairs):
                m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r[f"{name}_{k}"]
    return out


def moments(table: DataFrame, k: int) -> dict[str, Moments]:
    columns = [f"c{i}" for i in range(3 * k + 4)]
    return {job: Moments(k, n, m["gram"], m["diag"]) for job, (n, m) in products(table, columns, {"gram": F.lit(1.0), "diag": F.col("d")}).items()}


def common_pairs(links: DataFrame) -> DataFrame:
    """j < k or j = k, c and s: of every two that are neighbours or have one pointing at both, the entries of W'W (off its diagonal) and of W + W'.

    Rows are joined with themselves, so the work is the sum of the squared numbers of neighbours.
    """
    key = ["job"] if "job" in links.columns else []
    w = links.select(*key, "i", "j", "w")
    other = w.select(*key, "i", F.col("j").alias("k"), F.col("w").alias("v"))
    shared = w.join(other, [*key, "i"]).where("j < k").groupBy(*key, "j", "k").agg(F.sum(F.col("w") * F.col("v")).alias("c")).withColumn("s", F.lit(0.0))
    direct = w.select(*key, F.least("i", "j").alias("j"), F.greatest("i", "j").alias("k"), F.lit(0.0).alias("c"), F.when(F.col("i") == F.col("j"), 2 * F.col("w")).otherwise(F.col("w")).alias("s"))
    return settled(shared.unionByName(direct).groupBy(*key, "j", "k").agg(F.sum("c").alias("c"), F.sum("s").alias("s")))


def _traces(pairs: DataFrame, squares: DataFrame) -> dict[str, np.ndarray]:
    """For each job the traces of B_r S B_s S, with B_1 = 2 (W'W less its diagonal), B_2 = W + W' and S the squared residuals (job, id, s2)."""
    if "job" not in pairs.columns:
        return _shared_traces(pairs, squares)
    of = lambda c, s: squares.select("job", F.col("id").alias(c), F.col("s2").alias(s))
    met = pairs.join(of("j", "sj"), ["job", "j"]).join(of("k", "sk"), ["job", "k"])
    both = F.when(F.col("j") == F.col("k"), 1.0).otherwise(2.0) * F.col("sj") * F.col("sk")
    sums = met.groupBy("job").agg(F.sum(4 * F.col("c") * F.col("c") * both).alias("a"), F.sum(2 * F.col("c") * F.col("s") * both).alias("b"), F.sum(F.col("s") * F.col("s") * both).alias("d"))
    return {r["job"]: np.array([[r["a"], r["b"]], [r["b"], r["d"]]]) for r in sums.collect()}


def _shared_traces(pairs: DataFrame, squares: DataFrame) -> dict[str, np.ndarray]:
    """``_traces`` of jobs on the same links: each pair is met once, with its squares of all jobs beside each other."""
    names = sorted(r[0] for r in squares.select("job").distinct().collect())
    if not names:
        return {}
    wide = settled(squares.groupBy("id").agg(*(F.max(F.when(F.col("job") == name, F.col("s2"))).alias(f"s{n}") for n, name in enumerate(names))))
    of = lambda c: wide.select(F.col("id").alias(c), *(F.col(f"s{n}").alias(f"{c}{n}") for n in range(len(names))))
    met = pairs.join(of("j"), "j").join(of("k"), "k")
    twice = F.when(F.col("j") == F.col("k"), 1.0).otherwise(2.0)
    both = [twice * F.col(f"j{n}") * F.col(f"k{n}") for n in range(len(names))]
    sums = met.agg(*(F.sum(v).alias(f"{c}{n}") for n, w in enumerate(both) for c, v in (("a", 4 * F.col("c") * F.col("c") * w), ("b", 2 * F.col("c") * F.col("s") * w), ("d", F.col("s") * F.col("s") * w)))).first()
    return {name: np.array([[sums[f"a{n}"], sums[f"b{n}"]], [sums[f"b{n}"], sums[f"d{n}"]]]) for n, name in enumerate(names) if sums[f"a{n}"] is not None}


def two_stage(m: Moments, y: np.ndarray, z: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Coefficients of z on y with the instruments h."""
    hz, hy = h.T @ m.gram @ z, h.T @ m.gram @ y
    first = np.linalg.lstsq(h.T @ m.gram @ h, np.column_stack([hz, hy]), rcond=None)[0]
    return np.linalg.solve(hz.T @ first[:, :-1], hz.T @ first[:, -1])


def _curve(m: Moments, u: np.ndarray, wu: np.ndarray, wwu: np.ndarray) -> np.ndarray:
    """The two moments u(r)'A u(r) / n, A_1 = W'W less its diagonal and A_2 = W, with u(r) = u - r Wu, as quadratics in r: rows of three coefficients."""
    g, d = (lambda a, b: a @ m.gram @ b), (lambda a, b: a @ m.diag @ b)
    first = [g(wu, wu) - d(u, u), -2 * (g(wu, wwu) - d(u, wu)), g(wwu, wwu) - d(wu, wu)]
    return np.array([first, [g(u, wu), -g(u, wwu) - g(wu, wu), g(wu, wwu)]]) / m.n


def least_rho(curve: np.ndarray, weight: np.ndarray) -> float:
    """rho within the bounds that minimises the weighted moments."""

    def loss(r):
        v = curve @ np.array([np.ones_like(r), r, r * r])
        return np.einsum("ij,ik,kj->j", v, weight, v)

    grid = np.linspace(-BOUND, BOUND, 3601)
    best = float(grid[np.lexsort((np.abs(grid - START), loss(grid)))[0]])
    for step in (5e-4, 1e-5, 1e-7):  # around the best point of the grid
        near = np.clip(np.linspace(best - step, best + step, 401), -BOUND, BOUND)
        best = float(near[np.argmin(loss(near))])
    return best


@dataclasses.dataclass
class Fit:
    """Coordinates of what a job's fit has come to. ``rho`` is 0 in models without a spatial error."""

    m: Moments
    model: str
    coef: np.ndarray
    rho: float
    h: np.ndarray
    cov: np.ndarray | None = None
    rho_se: float | None = None

    @property
    def is_lag(self) -> bool:
        return self.model in ("sar", "sarar")

    @property
    def is_error(self) -> bool:
        return self.model in ("sem", "sarar")

    def residual(self, lags: int = 0) -> np.ndarray:
        """y - Z b, lagged."""
        return (self.m.y(lags) - self.m.z(self.is_lag, lags) @ self.coef[:, None])[:, 0]

    def innovation(self) -> np.ndarray:
        return self.residual() - self.rho * self.residual(1)

    def curve(self) -> np.ndarray:
        return _curve(self.m, self.residual(), self.residual(1), self.residual(2))

    def transformed(self, lags: int = 0) -> np.ndarray:
        return self.m.z(self.is_lag, lags) - self.rho * self.m.z(self.is_lag, lags + 1)

    def instruments(self) -> np.ndarray:
        return self.h if self.is_lag else self.transformed()


def start(m: Moments, model: str) -> Fit:
    """Two-stage least squares; in error models rho by the plain moments and once more two-stage least squares on what it transforms."""
    fit = Fit(m, model, np.zeros(0), 0.0, m.instruments())
    fit.coef = two_stage(m, m.y()[:, 0], m.z(fit.is_lag), fit.instruments())
    if fit.is_error:
        fit.rho = least_rho(fit.curve(), np.eye(2))
        fit.coef = two_stage(m, (m.y() - fit.rho * m.y(1))[:, 0], fit.transformed(), fit.instruments())
    return fit


def _weighted(fit: Fit, squares: np.ndarray, traces: np.ndarray | None) -> np.ndarray:
    """The covariance of the coefficients, into ``fit``, and that of the two moments. ``squares``: products of the columns weighted with squared innovations."""
    m, z, h = fit.m, fit.transformed(), fit.instruments()
    hz = h.T @ m.gram @ z
    p = np.linalg.lstsq(h.T @ m.gram @ h, hz, rcond=None)[0]
    p = m.n * p @ np.linalg.inv(hz.T @ p)
    s = h.T @ squares @ h
    fit.cov = p.T @ s @ p / m.n**2
    if traces is None:
        return np.eye(2)
    e, we = fit.innovation(), fit.residual(1) - fit.rho * fit.residual(2)
    wz = fit.transformed(1)
    alpha = -np.column_stack([2 * (wz.T @ m.gram @ we - z.T @ m.diag @ e), z.T @ m.gram @ we + wz.T @ m.gram @ e]) / m.n
    return traces / (2 * m.n) + alpha.T @ p.T @ s @ p @ alpha / m.n


def _evaluate(fits: dict[str, Fit], table: DataFrame, pairs: DataFrame | None) -> dict[str, np.ndarray]:
    """The covariance of each job's moments at its present rho: a pass over the rows and one over the pairs."""
    spark, columns = table.sparkSession, [c for c in table.columns if c[0] == "c"]
    innovations = spark.createDataFrame([(job, [float(v) for v in f.innovation()]) for job, f in fits.items()], "job string, at array<double>")
    e = sum((F.col("at")[k] * F.col(c) for k, c in enumerate(columns)), F.lit(0.0))
    rows = table.join(F.broadcast(innovations), "job").withColumn("s2", e * e)
    squares = products(rows, columns, {"s": F.col("s2")})
    error = {job for job, f in fits.items() if f.is_error}
    traces = _traces(pairs, rows.where(F.col("job").isin(*error)).select("job", "id", "s2")) if error else {}
    return {job: _weighted(f, squares[job][1]["s"], traces.get(job)) for job, f in fits.items()}


def select_models(spark: SparkSession, known: dict[str, Moments], trace: dict[str, float], alpha: float = 0.05) -> DataFrame:
    """job, the four LM statistics of least squares, and the model and basis that the rule gives."""
    rows = []
    for job, m in known.items():
        b = two_stage(m, m.y()[:, 0], m.x(), m.x())
        e, wf = m.y()[:, 0] - m.x() @ b, m.x(1) @ b
        s2, t = e @ m.gram @ e / m.n, trace[job]
        we = m.y(1)[:, 0] - wf
        s_e, s_l = e @ m.gram @ we / s2, e @ m.gram @ m.y(1)[:, 0] / s2
        rest = wf - m.x() @ two_stage(m, wf, m.x(), m.x())
        d = rest @ m.gram @ rest / s2 + t
        rows.append((job, *(float(v) for v in (s_e**2 / t, s_l**2 / d, (s_e - t / d * s_l) ** 2 / (t * (1 - t / d)), (s_l - s_e) ** 2 / (d - t)))))
    names = ["lm_err", "lm_lag", "rlm_err", "rlm_lag"]
    out = spark.createDataFrame(rows, "job string, " + ", ".join(f"{n} double" for n in names))
    model, basis = lm_rule(*map(F.col, names), [tests.chi2_1_p_col(F.col(n)) for n in names], alpha)
    return out.withColumns({"model": model, "basis": basis})


def _trace_terms(links: DataFrame, jobs: Sequence[str]) -> dict[str, float]:
    key = ["job"] if "job" in links.columns else []
    back = links.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    terms = links.join(back, [*key, "i", "j"], "left").groupBy(*key).agg(F.sum(F.col("w") * (F.col("w") + F.coalesce("v", F.lit(0.0)))).alias("t"))
    found = {r["job"] if key else None: r["t"] for r in terms.collect()}
    return {job: found.get(job if key else None, 0.0) for job in jobs}


def fit_all(rows: DataFrame, links: DataFrame, y: str, xs: Sequence[str], model: str = "sarar") -> dict[str, Fit]:
    """The fit of each job in ``rows`` (job, id, y, xs) on ``links`` (i, j, w; with a column job where jobs differ in theirs).

    ``model`` is one of MODELS, or "selected" for what the LM tests of each job select. Rows have to be complete, and links
    join rows that are there.
    """
    if model not in (*MODELS, "selected"):
        raise ValueError(f"unknown model: {model}")
    links = settled(links)
    table = lagged(rows, links, y, xs)
    known = moments(table, len(xs) + 1)
    models = dict.fromkeys(known, model)
    if model == "selected":
        models = {r["job"]: r["model"] for r in select_models(rows.sparkSession, known, _trace_terms(links, list(known))).collect()}
    fits = {job: start(m, models[job]) for job, m in known.items()}
    error = {job: f for job, f in fits.items() if f.is_error}
    pairs = common_pairs(links) if error else None
    if error:
        for job, psi in _evaluate(error, table, pairs).items():
            fits[job].rho = least_rho(fits[job].curve(), np.linalg.inv(psi))
    for job, psi in _evaluate(fits, table, pairs).items() if fits else ():
        f = fits[job]
        if f.is_error:
            slope = f.curve() @ np.array([0.0, 1.0, 2 * f.rho])
            f.rho_se = float((slope @ np.linalg.solve(psi, slope) * f.m.n) ** -0.5)
    return fits


def terms(fit: Fit, xs: Sequence[str]) -> list[tuple[str, float, float | None, float | None]]:
    """term, estimate, error and two-sided p: the constant and regressors, lambda_lag, rho_error, and pseudo_r2, 1 - SSR / SST of y - Z b."""
    m = fit.m
    out = [(name, b, s, tests.normal_p(b / s) if s else None) for name, b, s in zip(["const", *xs, "lambda_lag"], map(float, fit.coef), map(float, np.sqrt(np.diag(fit.cov))))]
    if fit.is_error:
        out.append(("rho_error", fit.rho, fit.rho_se, tests.normal_p(fit.rho / fit.rho_se)))
    y, one, rest = m.y()[:, 0], m.x()[:, 0], fit.residual()
    sst = y @ m.gram @ y - (one @ m.gram @ y) ** 2 / m.n
    return [*out, ("pseudo_r2", float(1 - rest @ m.gram @ rest / sst), None, None)]


def fit_jobs(rows: DataFrame, links: DataFrame, y: str, xs: Sequence[str], model: str = "sarar") -> DataFrame:
    """RESULT rows for each job, see ``fit_all`` and ``terms``."""
    found = fit_all(rows, links, y, xs, model)
    return rows.sparkSession.createDataFrame([(job, f.model, f.m.n, *t) for job, f in found.items() for t in terms(f, xs)], RESULT)
