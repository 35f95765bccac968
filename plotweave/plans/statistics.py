"""Queries of spatial statistics, regressions and cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tests
from ..operators import crossval, lattice as lt, spreg, stats, weights
from . import inputs
from .inputs import ME, PT
from .register import query
from .spatial import K, grid, sql_assign, sql_knn

SAMPLE = "sample AS (SELECT id, x, y, ln(area) AS v, ln(pc1) AS x1, ln(bc) AS x2, pc1, pc2, cc, bc, fk FROM pt JOIN me ON me.addr_key = pt.id WHERE area > 0 AND pc1 > 0 AND pc2 > 0 AND cc > 0 AND bc > 0 AND fk > 0)"
BASE = f"WITH {PT}, {ME}, {SAMPLE}"


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.points(spark, sf_dir).join(inputs.measures(spark, sf_dir).withColumnRenamed("addr_key", "id"), "id")
    return p.where("area > 0 AND pc1 > 0 AND pc2 > 0 AND cc > 0 AND bc > 0 AND fk > 0").selectExpr("id", "x", "y", "ln(area) AS v", "ln(pc1) AS x1", "ln(bc) AS x2", *inputs.MEASURES)


def one_row(spark: SparkSession, values: dict[str, float | int], places: int = 6) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values)).select(*(F.round(k, places).alias(k) if isinstance(v, float) else F.col(k) for k, v in values.items()))


_COV = f"{BASE}, c AS (SELECT covar_samp(v, x1) AS cy1, covar_samp(v, x2) AS cy2, var_samp(x1) AS c11, var_samp(x2) AS c22, covar_samp(x1, x2) AS c12, var_samp(v) AS cyy, avg(v) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM sample), b AS (SELECT *, (cy1 * c22 - cy2 * c12) / (c11 * c22 - c12 * c12) AS b1, (cy2 * c11 - cy1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM c)"


@query(f"{_COV}, s AS (SELECT *, (cyy - b1 * cy1 - b2 * cy2) * (n - 1) / (n - 3) AS s2 FROM b) SELECT round(my - b1 * m1 - b2 * m2, 6) AS const, round(b1, 6) AS b1, round(b2, 6) AS b2, round(sqrt(s2 * c22 / (c11 * c22 - c12 * c12) / (n - 1)), 6) AS se1, round(sqrt(s2 * c11 / (c11 * c22 - c12 * c12) / (n - 1)), 6) AS se2, round((b1 * cy1 + b2 * cy2) / cyy, 6) AS r2, n FROM s")
def ols_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stats.ols(sample(spark, sf_dir), "v", ["x1", "x2"])
    return one_row(spark, {"const": f.coef["const"], "b1": f.coef["x1"], "b2": f.coef["x2"], "se1": f.se["x1"], "se2": f.se["x2"], "r2": f.r2, "n": f.n})


def _sql_lm(x: str) -> str:
    """CTEs that end in lm: the four statistics for one regressor."""
    knn = sql_knn().replace("FROM pt p, pt q", "FROM sample p, sample q")
    return f"""{BASE}, {knn}, o AS (SELECT regr_slope(v, {x}) AS b, regr_intercept(v, {x}) AS a FROM sample), d AS (SELECT id, v, {x} AS xx, v - a - b * {x} AS e, a + b * {x} AS f FROM sample, o),
l AS (SELECT i AS id, sum(v / {K}) AS wy, sum(e / {K}) AS we, sum(f / {K}) AS wf FROM kn JOIN d ON d.id = kn.j GROUP BY i), g AS (SELECT d.*, wy, we, wf FROM d JOIN l ON l.id = d.id),
t AS (SELECT count(*) / {K * K}.0::DOUBLE + (SELECT count(*) FROM kn a JOIN kn b ON a.i = b.j AND a.j = b.i) / {K * K}.0::DOUBLE AS t FROM kn),
m AS (SELECT sum(e * e) / count(*) AS s2, sum(e * we) AS ewe, sum(e * wy) AS ewy, regr_syy(wf, xx) - regr_sxy(wf, xx) * regr_sxy(wf, xx) / regr_sxx(wf, xx) AS ssr FROM g),
k AS (SELECT ewe / s2 AS se, ewy / s2 AS sl, ssr / s2 + t AS dd, t FROM m, t),
lm AS (SELECT se * se / t AS lm_err, sl * sl / dd AS lm_lag, (se - t / dd * sl) * (se - t / dd * sl) / (t * (1 - t / dd)) AS rlm_err, (sl - se) * (sl - se) / (dd - t) AS rlm_lag FROM k)"""


def _weights(d: DataFrame) -> DataFrame:
    return weights.knn_weights(d, K).persist()


@query(f"{_sql_lm('x1')} SELECT round(lm_err, 5) AS lm_err, round(lm_lag, 5) AS lm_lag, round(rlm_err, 5) AS rlm_err, round(rlm_lag, 5) AS rlm_lag FROM lm")
def lm_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).persist()
    return one_row(spark, stats.lm_tests(d, "v", ["x1"], _weights(d)), 5)


# Fixed value: the 95 % point of chi-square with one degree of freedom.
_CRITICAL = 3.841458820694124


@query(f"{_sql_lm('x2')}, s AS (SELECT *, lm_err > {_CRITICAL} AS err, lm_lag > {_CRITICAL} AS lag, rlm_err > {_CRITICAL} AS rerr, rlm_lag > {_CRITICAL} AS rlag FROM lm) SELECT CASE WHEN NOT err AND NOT lag THEN 'ols' WHEN err AND NOT lag THEN 'sem' WHEN lag AND NOT err THEN 'sar' WHEN rerr AND NOT rlag THEN 'sem' WHEN rlag AND NOT rerr THEN 'sar' WHEN NOT rerr AND NOT rlag THEN CASE WHEN lm_err >= lm_lag THEN 'sem' ELSE 'sar' END ELSE 'sarar' END AS model FROM s")
def lm_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).persist()
    row = spark.createDataFrame([tuple(stats.lm_tests(d, "v", ["x2"], _weights(d)).values())], ["lm_err", "lm_lag", "rlm_err", "rlm_lag"])
    cols = [F.col(c) for c in row.columns]
    model, _ = stats.lm_rule(*cols, [tests.chi2_1_p_col(c) for c in cols])
    return row.select(model.alias("model"))


@query(f"""WITH {PT}, {sql_knn()}, z AS (SELECT id, area - (SELECT avg(area) FROM pt) AS z FROM pt), m AS (SELECT count(*) AS n, sum(z * z) AS m2, sum(z * z * z * z) AS m4 FROM z),
c AS (SELECT count(*) / {K}.0::DOUBLE AS s0, sum(a.z * b.z / {K}) AS num FROM kn JOIN z a ON a.id = kn.i JOIN z b ON b.id = kn.j),
s1 AS (SELECT count(*) / {K * K}.0::DOUBLE + (SELECT count(*) FROM kn a JOIN kn b ON a.i = b.j AND a.j = b.i) / {K * K}.0::DOUBLE AS s1 FROM kn),
s2 AS (SELECT sum(s * s) AS s2 FROM (SELECT id, sum(1.0::DOUBLE / {K}) AS s FROM (SELECT i AS id FROM kn UNION ALL SELECT j FROM kn) GROUP BY id)),
q AS (SELECT n::DOUBLE AS n, n / s0 * num / m2 AS i, -1.0::DOUBLE / (n - 1) AS e, n * m4 / (m2 * m2) AS b2, s0, s1, s2 FROM m, c, s1, s2),
v AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e AS variance FROM q)
SELECT round(i, 8) AS i, round(e, 8) AS expected, round(variance, 8) AS variance, round((i - e) / sqrt(variance), 5) AS z FROM v""")
def morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.points(spark, sf_dir).persist()
    out = stats.morans_i(p, "area", _weights(p))
    return one_row(spark, out, 8).withColumn("z", F.round("z", 5))


@query(f"WITH {PT}, {sql_assign()}, d AS (SELECT area, a.cell FROM pt JOIN a ON a.id = pt.id WHERE cell IS NOT NULL), g AS (SELECT cell, avg(area) AS m FROM d GROUP BY cell), s AS (SELECT sum((area - m) * (area - m)) AS ssw, count(*) AS n, count(DISTINCT d.cell) AS groups, var_pop(area) * count(*) AS sst FROM d JOIN g ON g.cell = d.cell) SELECT n, groups, round(1 - ssw / sst, 6) AS r2, round(1 - ssw / sst * ((n - 1) / nullif(n - groups, 0)), 6) AS adj_r2 FROM s")
def cell_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.fixed_effects_r2(lt.assign(inputs.points(spark, sf_dir), grid()), "cell", "area")
    return out.withColumns({c: F.round(c, 6) for c in ("r2", "adj_r2")})


@query(f"{BASE}, d AS (SELECT x1, ln(pc2) AS t, ln(pc2) - ln(pc1) AS den, ln(pc1) AS fp, x2 FROM sample) SELECT round(regr_slope(t, x2), 6) AS total, round(regr_slope(fp, x2), 6) AS floor_price, round(regr_slope(den, x2), 6) AS density, round(CASE WHEN sign(regr_slope(fp, x2)) = sign(regr_slope(den, x2)) THEN regr_slope(fp, x2) / regr_slope(t, x2) END, 6) AS share_price, abs(regr_slope(t, x2) - regr_slope(fp, x2) - regr_slope(den, x2)) < 1e-9 AS additive FROM d")
def channel_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total that is a product, in logs: the slopes of its two factors add up to that of the total; shares only where both have its sign."""
    d = sample(spark, sf_dir).selectExpr("ln(pc2) AS t", "ln(pc2) - ln(pc1) AS den", "ln(pc1) AS fp", "x2")
    a, b, c = (F.regr_slope(col, "x2") for col in ("t", "fp", "den"))
    return d.agg(F.round(a, 6).alias("total"), F.round(b, 6).alias("floor_price"), F.round(c, 6).alias("density"), F.round(F.when(F.signum(b) == F.signum(c), b / a), 6).alias("share_price"), (F.abs(a - b - c) < 1e-9).alias("additive"))


_BLOCKS = f"{BASE}, d AS (SELECT id, v, x1, id % 10 AS block FROM sample), p AS (SELECT block AS k, (SELECT avg(v) FROM d WHERE block <> b.block) AS m, (SELECT regr_slope(v, x1) FROM d WHERE block <> b.block) AS s, (SELECT regr_intercept(v, x1) FROM d WHERE block <> b.block) AS a FROM (SELECT DISTINCT block FROM d) b), e AS (SELECT block, v - m AS em, v - a - s * x1 AS eo FROM d JOIN p ON p.k = d.block)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.leave_block_out(sample(spark, sf_dir).withColumn("block", F.col("id") % 10), "block", "v", "x1")


@query(f"{_BLOCKS} SELECT round(sqrt(avg(em * em)), 6) AS null_training_block_mean, round(sqrt(avg(eo * eo)), 6) AS null_ols, count(*) AS n FROM e")
def cv_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).agg(F.round(stats.rmse("pred_mean", "v"), 6).alias("null_training_block_mean"), F.round(stats.rmse("pred_ols", "v"), 6).alias("null_ols"), F.count("*").alias("n"))


@query(f"{_BLOCKS} SELECT block, count(*) AS n, round(sqrt(avg(eo * eo)), 6) AS rmse FROM e GROUP BY block")
def block_cv_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("block").agg(F.count("*").alias("n"), F.round(stats.rmse("pred_ols", "v"), 6).alias("rmse"))


_PAIRS = [(a, b) for i, a in enumerate(inputs.MEASURES) for b in inputs.MEASURES[i + 1 :]]


@query(f"{BASE}, r AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS r_{m}" for m in inputs.MEASURES) + " FROM sample) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS pearson, round(corr(r_{a}, r_{b}), 6) AS spearman FROM r" for a, b in _PAIRS))
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.pair_correlations(sample(spark, sf_dir), inputs.MEASURES, "id")
    return out.withColumns({c: F.round(c, 6) for c in ("pearson", "spearman")})


@query()
def correlation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.pair_correlations(sample(spark, sf_dir), inputs.MEASURES, "id")
    return out.withColumn("p", tests.correlation_p_col(F.col("pearson"), F.col("n").cast("double")))


@query(f"{BASE} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS n, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median, round((max({m}) - min({m})) / avg({m}), 6) AS relative_range, round(stddev_samp({m}) / avg({m}) * 100, 6) AS cv FROM sample" for m in inputs.MEASURES))
def descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.descriptives(sample(spark, sf_dir), inputs.MEASURES)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "relative_range", "cv")})


@query(f"{BASE}, " + "p AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, {m} AS v, row_number() OVER (ORDER BY {m} DESC) AS k, count(*) OVER () AS n FROM sample" for m in ("pc1", "pc2", "bc")) + ") SELECT measure, max(n) AS n, round(sum(v) FILTER (k <= ceil(0.2 * n)), 5) AS top, round(sum(v) FILTER (k <= ceil(0.2 * n)) / sum(v) FILTER (k > ceil(0.2 * n)), 6) AS ratio, round(sum(v) FILTER (k <= ceil(0.2 * n)) / sum(v), 6) AS top_share FROM p GROUP BY measure")
def pareto_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.top_share(sample(spark, sf_dir), ["pc1", "pc2", "bc"])
    return out.withColumns({"top": F.round("top", 5), "ratio": F.round("ratio", 6), "top_share": F.round("top_share", 6)})


_MOVED = f"{BASE}, d AS (SELECT pc1 AS a, pc1 + CASE WHEN id % 7 = 0 THEN cc / 50 ELSE cc / 1000 END AS b, id % 7 = 0 AS lost FROM sample), r AS (SELECT a, b, lost, abs(b - a) / abs(a) AS rel FROM d)"
_MOVES = "count(rel) AS n, round(corr(a, b), 6) AS pearson, round(avg(CAST(rel <= 0.01 AS INTEGER)), 6) AS within_1pct, round(median(rel), 8) AS median_rel, round(quantile_cont(rel, 0.9), 8) AS p90_rel, round(max(rel), 8) AS max_rel, round(avg(b) - avg(a), 8) AS mean_shift"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, sf_dir).selectExpr("pc1 AS a", "pc1 + CASE WHEN id % 7 = 0 THEN cc / 50 ELSE cc / 1000 END AS b", "id % 7 = 0 AS lost")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6 if c in ("pearson", "within_1pct") else 8) for c in ("pearson", "within_1pct", "median_rel", "p90_rel", "max_rel", "mean_shift")})


@query(f"{_MOVED} SELECT {_MOVES} FROM r")
def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_moved(spark, sf_dir).agg(*stats.movement(F.col("a"), F.col("b"))))


@query(f"{_MOVED} SELECT 'all' AS part, {_MOVES} FROM r UNION ALL SELECT CASE WHEN lost THEN 'boundary' ELSE 'interior' END, {_MOVES} FROM r GROUP BY lost")
def movement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, interior and boundary in one pass: each row counts in two groups."""
    d = _moved(spark, sf_dir).withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("lost"), "boundary").otherwise("interior"))))
    return _rounded(d.groupBy("part").agg(*stats.movement(F.col("a"), F.col("b"))))


@query(f"{BASE} SELECT round(1 / (1 - corr(x1, x2) * corr(x1, x2)), 6) AS x1, round(1 / (1 - corr(x1, x2) * corr(x1, x2)), 6) AS x2 FROM sample")
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row(spark, stats.vif(sample(spark, sf_dir), ["x1", "x2"]))


def _measure_rows(d: DataFrame) -> DataFrame:
    """A job per measure: the log value on the log measure."""
    return d.select("id", "v", F.explode(F.array(*(F.struct(F.lit(m).alias("job"), F.ln(m).alias("m")) for m in inputs.MEASURES))).alias("s")).select("s.job", "id", "v", "s.m")


@query()
def sarar_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag and error model of each measure, all on the same links."""
    d = sample(spark, sf_dir).persist()
    return spreg.fit_jobs(_measure_rows(d), _weights(d), "v", ["m"])


@query()
def selected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each measure the model that its LM tests select, fitted."""
    d = sample(spark, sf_dir).persist()
    return spreg.fit_jobs(_measure_rows(d), _weights(d), "v", ["m"], "selected")


_FOLD = "CAST(id % 10 AS STRING) AS fold"


@query(f"{BASE}, f AS (SELECT DISTINCT id % 10 AS fold FROM sample), p AS (SELECT fold, p.id AS i, q.id AS j, row_number() OVER (PARTITION BY fold, p.id ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.id) AS nth FROM f, sample p, sample q WHERE p.id <> q.id AND p.id % 10 <> fold AND q.id % 10 <> fold) SELECT CAST(fold AS VARCHAR) AS fold, i, j FROM p WHERE nth <= {K}")
def cv_training_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every training set by themselves."""
    return crossval.training_links(sample(spark, sf_dir).selectExpr("id", "x", "y", _FOLD), K).select("fold", "i", "j")


_SPECS = {"x1": ["x1"], "x2": ["x2"]}
_TREND = "SELECT '{m}' AS spec, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS n_pred, round(sqrt(sum(ols) / sum(n)), 6) AS rmse_ols, round(sqrt(sum(trend) / sum(n)), 6) AS rmse_trend, round(sqrt(sum(trend) / sum(n)), 6) AS rmse_recal, round(sqrt(sum(mean) / sum(n)), 6) AS rmse_mean FROM e_{m}"


@query(f"{BASE}, " + ", ".join(f"p_{m} AS (SELECT k, avg(v) AS m, regr_slope(v, {m}) AS s, regr_intercept(v, {m}) AS a FROM (SELECT DISTINCT id % 10 AS k FROM sample) f JOIN sample ON id % 10 <> k GROUP BY k), e_{m} AS (SELECT k, count(*) AS n, sum((v - a - s * {m}) * (v - a - s * {m})) AS ols, sum((v - a - s * {m}) * (v - a - s * {m})) AS trend, sum((v - m) * (v - m)) AS mean FROM sample JOIN p_{m} ON k = id % 10 GROUP BY k)" for m in _SPECS) + " " + " UNION ALL ".join(_TREND.format(m=m) for m in _SPECS))
def cv_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of ``cv_training_links`` with models without space, whose trend is least squares."""
    found = crossval.cross_validate(sample(spark, sf_dir).selectExpr("id", "x", "y", "v", "x1", "x2", _FOLD), "v", _SPECS, K, "ols")
    out = crossval.scores(found).drop("mean_lambda")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("rmse")})


@query()
def cv_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag and error models on ten spatial blocks, with the weights of each training set."""
    d = crossval.spatial_blocks(sample(spark, sf_dir).select("id", "x", "y", "v", "x1", "x2"))
    return crossval.scores(crossval.cross_validate(d, "v", _SPECS, K))


@query()
def kmeans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial blocks for cross-validation: the best k-means of 25 starts."""
    return crossval.spatial_blocks(inputs.points(spark, sf_dir)).groupBy(F.col("fold").cast("int").alias("block")).agg(F.count("*").alias("n"))
