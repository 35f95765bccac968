"""Statistics by sufficient sums: correlation, least squares, spatial tests, fixed effects, cross-validation.

Only moment matrices of k regressors reach the driver. Everything that has a row per observation stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.tests import t_p
from .lineage import settled


def average_rank(col: str, partition: Sequence[str] = ()) -> Column:
    """Ranks with ties at their mean; null for null."""
    own = Window.partitionBy(*partition, F.col(col).isNull())
    ties = Window.partitionBy(*partition, col)
    return F.when(F.col(col).isNotNull(), F.rank().over(own.orderBy(col)) + (F.count("*").over(ties) - 1) / 2)


def _values(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """The kept columns, m (a column's name) and v (its value), without nulls."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols))).alias("s")).select(*keep, "s.*").where("v IS NOT NULL")


def _placed(values: DataFrame, down: bool = False) -> DataFrame:
    """m, v, n (rows of this value) and before (rows of m that come earlier) for each distinct value.

    Counts of values are dealt by range; a task adds up its own range, and gets the sums of the ranges before as one row
    for each, so no task sorts a whole column.
    """
    by = ["m", F.desc("v") if down else F.asc("v")]
    dealt = settled(values.groupBy("m", "v").agg(F.count("*").alias("n")).repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy("_p", "m").agg(F.sum("n").alias("_s"))
    earlier = sums.select("_p", "m", F.coalesce(F.sum("_s").over(Window.partitionBy("m").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("_p", "m").orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_o", own).join(earlier, ["_p", "m"]).select("m", "v", "n", (F.col("_o") + F.col("_b")).alias("before"))


def ranks(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """key and r_<col> for each column: average ranks, found for the distinct values of all columns at once."""
    place = _placed(_values(df, cols)).select("m", "v", (F.col("before") + (F.col("n") + 1) / 2).alias("r"))
    return _values(df, cols, key).join(place, ["m", "v"]).groupBy(key).pivot("m", list(cols)).agg(F.first("r")).withColumnsRenamed({c: f"r_{c}" for c in cols})


def pair_correlations(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """a, b (a before b), n, pearson, spearman for all pairs over rows where both are there; ranks are taken over each column."""
    both = df.select(key, *cols).join(ranks(df, cols, key), key)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("pearson"), F.corr(f"r_{a}", f"r_{b}").alias("spearman")) for a, b in pairs]
    return both.agg(F.array(*row).alias("p")).select(F.explode("p").alias("p")).select("p.*")


#: Counts of the sketch that brackets a quantile: its rank is off by one in so many rows at most.
ACCURACY = 10_000


def quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """m (a column's name), share, value: exact quantiles with linear interpolation; a column without values has no row.

    A sketch of each column (one pass; a few numbers to the driver) gives for each share a bracket that surely holds it. A
    second pass counts what lies before the bracket and keeps the distinct values inside, some four rows in 10,000, with
    the last value before and the first behind: the values at the two ranks around the share are among them.
    """
    values, shares = _values(df, cols), sorted(set(map(float, shares)))
    off = 2 / ACCURACY
    ask = F.array(*(F.lit(min(max(p + d, 0.0), 1.0)) for p in shares for d in (-off, off)))
    rough = values.groupBy("m").agg(F.percentile_approx("v", ask, ACCURACY).alias("q")).collect()
    spark, none = df.sparkSession, "m string, share double, value double"
    if not rough:
        return spark.createDataFrame([], none)
    brackets = spark.createDataFrame([(r["m"], [(p, r["q"][2 * i], r["q"][2 * i + 1]) for i, p in enumerate(shares)]) for r in rough], "m string, b array<struct<share:double,low:double,high:double>>")
    each = values.join(F.broadcast(brackets), "m").select("m", "v", F.inline("b")).withColumn("part", F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0))
    counts = each.groupBy("m", "share", "part", F.when(F.col("part") == 0, F.col("v")).alias("own")).agg(F.count("*").alias("n"), F.max("v").alias("last"), F.min("v").alias("first"))
    order = Window.partitionBy("m", "share").orderBy("part", "own").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"before": F.coalesce(F.sum("n").over(order), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("m", "share"))})
    placed = placed.withColumn("at", F.col("share") * (F.col("all") - 1))

    def value_at(k: Column) -> Column:
        held = (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        known = F.when(F.col("part") == 0, F.col("own")).when((F.col("part") < 0) & (k == F.col("before") + F.col("n") - 1), F.col("last")).when((F.col("part") > 0) & (k == F.col("before")), F.col("first"))
        return F.max(F.when(held, known))

    per = placed.groupBy("m", "share").agg(value_at(F.floor("at")).alias("l"), value_at(F.ceil("at")).alias("h"), F.max("at").alias("at"))
    sure = F.when(F.col("l").isNull() | F.col("h").isNull(), F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double"))
    return per.select("m", "share", sure.when(F.col("l") == F.col("h"), F.col("l")).otherwise((F.ceil("at") - F.col("at")) * F.col("l") + (F.col("at") - F.floor("at")) * F.col("h")).alias("value"))


def descriptives(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """measure, n, mean, median, relative range and CV in percent; medians come from ``quantiles``."""
    row = [F.struct(F.lit(c).alias("measure"), F.count(c).alias("n"), F.avg(c).alias("mean"), ((F.max(c) - F.min(c)) / F.avg(c)).alias("relative_range"), (F.stddev_samp(c) / F.avg(c) * 100).alias("cv")) for c in cols]
    medians = quantiles(df, cols, [0.5]).select(F.col("m").alias("measure"), F.col("value").alias("median"))
    out = df.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*").join(medians, "measure", "left")
    return out.select("measure", "n", "mean", "median", "relative_range", "cv")


def top_share(df: DataFrame, cols: Sequence[str], share: float = 0.2) -> DataFrame:
    """measure, n, top (sum of the ceil(share * n) largest), ratio top / rest, top_share."""
    place = _placed(_values(df, cols), down=True)
    place = place.join(place.groupBy("m").agg(F.sum("n").alias("all")), "m")
    taken = F.least(F.col("n"), F.greatest(F.ceil(F.lit(share) * F.col("all")) - F.col("before"), F.lit(0)))
    top, total = F.sum(F.col("v") * taken), F.sum(F.col("v") * F.col("n"))
    return place.groupBy(F.col("m").alias("measure")).agg(F.max("all").alias("n"), top.alias("top"), F.try_divide(top, total - top).alias("ratio"), (top / total).alias("top_share"))


@dataclass(frozen=True)
class Fit:
    """Coefficients by name (the constant is 'const'), standard errors, p-values, R2, n and the residual sum of squares."""

    coef: dict[str, float]
    se: dict[str, float]
    p: dict[str, float]
    r2: float
    n: int
    ssr: float

    def fitted(self) -> Column:
        out = F.lit(self.coef["const"])
        for name, b in self.coef.items():
            if name != "const":
                out = out + F.lit(b) * F.col(name)
        return out


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    """Least squares with a constant, from means and covariances of one aggregation over complete rows."""
    return ols_all(df, y, {"": xs})[""]


def ols_all(df: DataFrame, y: str, specs: Mapping[str, Sequence[str]]) -> dict[str, Fit]:
    """``ols`` of each specification over the rows that are complete in its own columns; all come out of one aggregation, so the rows are made once."""
    used = list(dict.fromkeys([y, *(x for xs in specs.values() for x in xs)]))
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    out = []
    for s, xs in enumerate(specs.values()):
        cols, whole = [y, *xs], F.lit(True)
        for c in cols:
            whole = whole & there(c)
        own = lambda c: F.when(whole, F.col(c))  # noqa: E731, B023
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
        out += [F.count_if(whole).alias(f"n_{s}"), *(F.avg(own(c)).alias(f"m{i}_{s}") for i, c in enumerate(cols)), *(F.covar_pop(own(a), own(b)).alias(f"c{k}_{s}") for k, (a, b) in enumerate(pairs))]
    row = df.select(*(F.col(c).cast("double").alias(c) for c in used)).agg(*out).first()
    return {name: _fitted(row, s, y, xs) for s, (name, xs) in enumerate(specs.items())}


def _fitted(row: Row, s: int, y: str, xs: Sequence[str]) -> Fit:
    """The fit of specification ``s`` from its means and covariances."""
    cols = [y, *xs]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    n, means = row[f"n_{s}"], np.array([row[f"m{i}_{s}"] for i in range(len(cols))])
    cov = np.zeros((len(cols),) * 2)
    for k, (a, b) in enumerate(pairs):
        cov[cols.index(a), cols.index(b)] = cov[cols.index(b), cols.index(a)] = row[f"c{k}_{s}"]
    b = np.linalg.solve(cov[1:, 1:], cov[1:, 0]) if xs else np.zeros(0)
    const = means[0] - b @ means[1:]
    sst = cov[0, 0] * n
    ssr = max(sst - n * (b @ cov[1:, 0]), 0.0)
    dof = n - len(cols)
    s2 = ssr / dof
    inverse = np.linalg.inv(cov[1:, 1:] * n) if xs else np.zeros((0, 0))
    se = np.sqrt(np.append(s2 * (1 / n + means[1:] @ inverse @ means[1:]), s2 * np.diag(inverse)))
    names, values = ["const", *xs], np.append(const, b)
    return Fit(dict(zip(names, map(float, values))), dict(zip(names, map(float, se))), {m: t_p(v / s, dof) for m, v, s in zip(names, values, se)}, float(1 - ssr / sst), n, float(ssr))


def trace_term(w: DataFrame) -> Column | float:
    """tr(W'W + WW): the sum of squared weights plus that of products with the reversed weight; one self-join on the pair."""
    back = w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    return float(w.join(back, ["i", "j"], "left").agg(F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("v", F.lit(0.0)))).first()[0])


def lm_tests(df: DataFrame, y: str, xs: Sequence[str], w: DataFrame) -> dict[str, float]:
    """lm_err, lm_lag, rlm_err, rlm_lag of least-squares residuals (Anselin and others 1996); df has ``id``, and every id has neighbours.

    y, residual and fitted value go through one join with the weights, so all three lags cost one shuffle.
    """
    fit = ols(df, y, xs)
    d = df.select("id", F.col(y).alias("y"), *xs, fit.fitted().alias("f")).withColumn("e", F.col("y") - F.col("f"))
    lags = w.join(d.select(F.col("id").alias("j"), "y", "e", "f"), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in ("y", "e", "f")))
    d = d.join(lags, "id")
    ee, ewe, ewy, n = d.agg(F.sum(F.col("e") * F.col("e")), F.sum(F.col("e") * F.col("we")), F.sum(F.col("e") * F.col("wy")), F.count("*")).first()
    s2, t = ee / n, trace_term(w)
    s_e, s_l, dd = ewe / s2, ewy / s2, ols(d, "wf", xs).ssr / s2 + t
    return {"lm_err": s_e**2 / t, "lm_lag": s_l**2 / dd, "rlm_err": (s_e - t / dd * s_l) ** 2 / (t * (1 - t / dd)), "rlm_lag": (s_l - s_e) ** 2 / (dd - t)}


def lm_rule(lm_err: Column, lm_lag: Column, rlm_err: Column, rlm_lag: Column, p: Sequence[Column], alpha: float = 0.05, both_robust: str = "sarar") -> tuple[Column, Column]:
    """(model, basis) by the plain tests, then the robust ones; ``p`` are the four p-values. A missing value selects nothing."""
    if both_robust not in ("sarar", "larger_robust_statistic"):
        raise ValueError(f"unknown choice for two robust tests: {both_robust}")
    err, lag, rerr, rlag = (c < alpha for c in p)
    missing = F.lit(False)
    for c in (lm_err, lm_lag, rlm_err, rlm_lag, *p):
        missing = missing | c.isNull()
    larger = F.when(rlm_err >= rlm_lag, "sem").otherwise("sar")
    cases = [
        (missing, F.lit(None).cast("string"), "LM tests failed"),
        (~err & ~lag, F.lit("ols"), "neither LM significant"),
        (err & ~lag, F.lit("sem"), "only LM-error significant"),
        (lag & ~err, F.lit("sar"), "only LM-lag significant"),
        (rerr & ~rlag, F.lit("sem"), "both LM significant; only robust LM-error significant"),
        (rlag & ~rerr, F.lit("sar"), "both LM significant; only robust LM-lag significant"),
        (~rerr & ~rlag, F.when(lm_err >= lm_lag, "sem").otherwise("sar"), "both LM significant, neither robust test is; larger plain LM statistic"),
        (F.lit(True), F.lit("sarar") if both_robust == "sarar" else larger, "both robust tests significant" + ("" if both_robust == "sarar" else "; larger robust statistic")),
    ]
    model, basis = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, m, b in cases[1:]:
        model, basis = model.when(test, m), basis.when(test, b)
    return model, basis


def morans_i(df: DataFrame, col: str, w: DataFrame) -> dict[str, float]:
    """I, its mean and variance under randomisation (Cliff and Ord), and the standard deviate; df has ``id``."""
    n, mean = df.agg(F.count(col), F.avg(col)).first()
    z = df.select("id", (F.col(col) - mean).alias("z"))
    cross = w.join(z.withColumnRenamed("id", "i"), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    s0, num = cross.agg(F.sum("w"), F.sum(F.col("w") * F.col("z") * F.col("zj"))).first()
    m2, m4 = z.agg(F.sum(F.col("z") ** 2), F.sum(F.col("z") ** 4)).first()
    ends = w.select(F.col("i").alias("id"), "w").union(w.select(F.col("j").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("s"))
    s1, s2 = trace_term(w), float(ends.agg(F.sum(F.col("s") ** 2)).first()[0])
    b2, i, e = n * m4 / m2**2, n / s0 * num / m2, -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    return {"i": i, "expected": e, "variance": var, "z": (i - e) / var**0.5}


def fixed_effects_r2(df: DataFrame, group: str, col: str) -> DataFrame:
    """One row: n, groups, R2 of group means and its adjusted value, from sums per group."""
    per = df.where(F.col(group).isNotNull() & F.col(col).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(col).alias("m"), (F.var_pop(col) * F.count("*")).alias("ssw"))
    total = per.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum("ssw").alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("s"))
    ssb = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    r2 = 1 - F.try_divide(F.col("ssw"), F.col("ssw") + ssb)
    return total.select("n", F.col("g").alias("groups"), r2.alias("r2"), (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - F.col("g"))).alias("adj_r2"))


def leave_block_out(df: DataFrame, block: str, y: str, x: str) -> DataFrame:
    """Rows with pred_mean and pred_ols: the mean and the least-squares line of all other blocks. Sums of the others are total less own, so no fold is scanned by itself."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx")]
    per, names = d.groupBy(block).agg(*sums), ("n", "sy", "sx", "sxy", "sxx")
    total = per.agg(*(F.sum(c).alias(f"t{c}") for c in names))
    rest = per.crossJoin(F.broadcast(total)).select(block, *((F.col(f"t{c}") - F.col(c)).alias(c) for c in names))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    line = rest.select(block, (F.col("sy") / F.col("n")).alias("pred_mean"), slope.alias("b"), (F.col("sy") / F.col("n") - slope * F.col("sx") / F.col("n")).alias("a"))
    return d.join(line, block).withColumn("pred_ols", F.col("a") + F.col("b") * F.col(x)).drop("a", "b")


def rmse(pred: str, y: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(pred)) * (F.col(y) - F.col(pred))))


def vif(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverted correlation matrix, which alone reaches the driver."""
    row = df.select(*cols).na.drop().agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)).first()
    m = np.eye(len(cols))
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            m[i, j] = m[j, i] = row[f"{i}_{j}"]
    return dict(zip(cols, map(float, np.diag(np.linalg.inv(m)))))


def movement(a: Column, b: Column) -> list[Column]:
    """Aggregates of how a variant b moved against a: shares and quantiles of the relative difference, correlations, shift of the mean."""
    rel = F.when((a == 0) & (b == 0), 0.0).when(a != 0, F.abs(b - a) / F.abs(a))
    return [F.count(rel).alias("n"), F.corr(a, b).alias("pearson"), F.avg((rel <= 0.01).cast("double")).alias("within_1pct"), F.median(rel).alias("median_rel"), F.percentile(rel, 0.9).alias("p90_rel"), F.max(rel).alias("max_rel"), (F.avg(b) - F.avg(a)).alias("mean_shift")]
