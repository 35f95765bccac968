"""Queries of variants, eligibility, extents and specification grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import percent, signed_verdict, stars
from ..operators import stats, variants
from . import inputs
from .inputs import GEO, ME, SG, TX
from .ranks import _SWEEP, sweep
from .register import query
from .statistics import BASE, one_row, sample

_VARIANTS = {"full": "TRUE", "no_parking": "NOT parking", "urgent": "purpose = '1-URGENT'", "below_cap": "price < 200000", "flagged": "price % 7 < 1"}


@query(f"WITH {TX} " + " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) FILTER ({c}) AS n, round(avg(price) FILTER ({c}), 4) AS mean FROM tx" for n, c in _VARIANTS.items()))
def sample_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.sample_variants(inputs.transactions(spark, sf_dir), {n: F.expr(c) for n, c in _VARIANTS.items()}, "price").withColumn("mean", F.round("mean", 4))


@query("SELECT c_nationkey AS nation, count(*) AS n, count(*) >= 60 AS estimated FROM customer GROUP BY 1")
def group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_threshold(inputs.layer(spark, sf_dir), "nation", 60)


@query("SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') AND p_size <= 30 AND p_partkey % 2 = 0 AND NOT p_partkey % 3 = 0 AS zone, CASE p_brand WHEN 'Brand#11' THEN 12.0::DOUBLE WHEN 'Brand#12' THEN 9.0::DOUBLE ELSE 5.0::DOUBLE END AS width FROM part")
def zone_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "p_size", "IF(p_partkey % 2 = 0, ' Yes', 'no') AS drive", "IF(p_partkey % 3 = 0, 'TRUE', '') AS bridge", "CAST(NULL AS STRING) AS tunnel")
    return p.select("p_partkey", variants.zone_eligible("p_brand", "p_size", "bridge", "tunnel", "drive", ["Brand#11", "Brand#12", "Brand#21"], 30).alias("zone"), variants.width_of(F.col("p_brand"), {"Brand#11": 12.0, "Brand#12": 9.0}).alias("width"))


@query(f"WITH {SG} SELECT count(*) AS n, count(*) FILTER (x1 BETWEEN 1000 AND 8000 AND x2 BETWEEN 1000 AND 8000 AND y1 BETWEEN 1000 AND 8000 AND y2 BETWEEN 1000 AND 8000) AS n_within, count(*) FILTER (greatest(x1, x2) >= 1000 AND least(x1, x2) <= 8000 AND greatest(y1, y2) >= 1000 AND least(y1, y2) <= 8000) AS n_box, count(*) FILTER ((x1 + x2) / 2 BETWEEN 1000 AND 8000 AND (y1 + y2) / 2 BETWEEN 1000 AND 8000) AS n_midpoint FROM sg")
def extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.extent_check(inputs.segments(spark, sf_dir), 1000.0, 1000.0, 8000.0, 8000.0)


@query(f"WITH {SG} SELECT seg, abs(x1 * y2 - x2 * y1 + x2 * 0 - 0 * y2 + 0 * y1 - x1 * 0) / 2 AS area FROM sg")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle of each segment and the origin."""
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return inputs.segments(spark, sf_dir).withColumn("p", F.array(corner("x1", "y1"), corner("x2", "y2"), corner("0D", "0D"))).select("seg", variants.polygon_area(F.col("p")).alias("area"))


@query("WITH r AS (SELECT (o_totalprice * 4) / o_totalprice AS a, (o_totalprice + 1) / o_totalprice AS b FROM orders WHERE o_totalprice <> 0) SELECT 'scaled' AS pair, median(a) AS rate, (max(a) - min(a)) / median(a) <= 1e-9 AS constant FROM r UNION ALL SELECT 'shifted', median(b), (max(b) - min(b)) / median(b) <= 1e-9 FROM r")
def constant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.read(spark, sf_dir, "orders").selectExpr("o_totalprice AS p", "o_totalprice * 4 AS a", "o_totalprice + 1 AS b")
    one = lambda c, n: variants.constant_rate(o, c, "p").select(F.lit(n).alias("pair"), "rate", "constant")
    return one("a", "scaled").unionByName(one("b", "shifted"))


_POS = ("area", "pc1", "cc", "fk")


@query(f"WITH {GEO}, {ME}, d AS (SELECT area, pc1, cc, fk, " + " + ".join(f"CAST(NOT coalesce({c} > 0, FALSE) AS INTEGER)" for c in _POS) + " AS bad FROM geo LEFT JOIN me ON me.addr_key = geo.addr_key) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c} = 0) AS n_zero, count(*) FILTER ({c} < 0) AS n_negative, count(*) FILTER (NOT coalesce({c} > 0, FALSE) AND bad = 1) AS n_only FROM d" for c in _POS))
def positivity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.layer(spark, sf_dir).join(inputs.measures(spark, sf_dir), "addr_key", "left")
    return variants.positivity_breakdown(d, _POS)


_CAND = {"mean": "avg(price)", "median": "median(price)", "least": "min(price)", "most": "max(price)"}


@query(f"WITH {TX}, g AS (SELECT addr_key, " + ", ".join(f"{e} AS {n}" for n, e in _CAND.items()) + ", avg(price) FILTER (NOT parking) AS t FROM tx GROUP BY addr_key) " + " UNION ALL ".join(f"SELECT '{n}' AS candidate, count(*) AS n, count(*) FILTER (abs({n} - t) <= 0.05 * abs(t)) AS n_match FROM g WHERE {n} IS NOT NULL AND t IS NOT NULL" for n in _CAND))
def hypothesis_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.sweep_scores(inputs.transactions(spark, sf_dir), "addr_key", {n: F.expr(e) for n, e in _CAND.items()}, F.avg(F.when(~F.col("parking"), F.col("price"))), 0.05)


_SPECS = {"a": ["x1"], "b": ["x2"], "c": ["x1", "x2"]}


@query(f"{BASE}, c AS (SELECT covar_samp(v, x1) AS cy1, covar_samp(v, x2) AS cy2, var_samp(x1) AS c11, var_samp(x2) AS c22, covar_samp(x1, x2) AS c12, var_samp(v) AS cyy, count(*) AS n FROM sample) SELECT 'a' AS spec, n, round(cy1 * cy1 / c11 / cyy, 6) AS r2 FROM c UNION ALL SELECT 'b', n, round(cy2 * cy2 / c22 / cyy, 6) FROM c UNION ALL SELECT 'c', n, round(((cy1 * c22 - cy2 * c12) * cy1 + (cy2 * c11 - cy1 * c12) * cy2) / (c11 * c22 - c12 * c12) / cyy, 6) FROM c")
def control_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, f in stats.ols_all(sample(spark, sf_dir), "v", _SPECS).items():
        one = one_row(spark, {"n": f.n, "r2": f.r2}).withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{BASE} SELECT type, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN regr_slope(v, x2) END, 6) AS slope, count(*) >= 30 AS estimated FROM sample JOIN (SELECT id AS k, type FROM pt) t ON t.k = sample.id GROUP BY type")
def type_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sample(spark, sf_dir).join(inputs.points(spark, sf_dir).select("id", "type"), "id")
    return d.groupBy("type").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 30, F.regr_slope("v", "x2")), 6).alias("slope"), (F.count("*") >= 30).alias("estimated"))


@query(f"{_SWEEP} SELECT k, count(*) FILTER (abs(abs(rho) - 0.9) < 1e-6) AS at_bound, count(*) FILTER (lag >= 1) AS lag_over, CAST(count(*) FILTER (p < 0.05) AS BIGINT) AS n_significant, min(beta) FILTER (measure < 2) > max(beta) FILTER (measure >= 2) AS accessibility_first FROM sw GROUP BY k")
def bound_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("measure")
    return sweep(spark, sf_dir).groupBy("k").agg(F.count_if(F.abs(F.abs("rho") - 0.9) < 1e-6).alias("at_bound"), F.count_if(F.col("lag") >= 1).alias("lag_over"), F.count_if(F.col("p") < 0.05).alias("n_significant"), (F.min(F.when(m < 2, F.col("beta"))) > F.max(F.when(m >= 2, F.col("beta")))).alias("accessibility_first"))


@query(f"{_SWEEP} SELECT k, measure, concat(CASE WHEN beta > 0 THEN '+ ' ELSE '- ' END, CASE WHEN p < 0.05 THEN 'sig' ELSE 'n.s.' END) AS verdict, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, format('{{:.1f}}%', p * 100) AS percent FROM sw")
def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir).select("k", "measure", signed_verdict(F.col("beta"), F.col("p")).alias("verdict"), stars(F.col("p")).alias("stars"), percent(F.col("p")).alias("percent"))


@query(f"WITH {ME} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) AS n, count(*) FILTER ({m} = 0) AS n_zero, round(avg(ln({m})) FILTER ({m} > 0), 6) AS mean_log, round(avg(ln({m} + 1)), 6) AS mean_log_plus FROM (SELECT {m} FROM me WHERE {m} >= 0)".replace(f"avg(ln({m})) FILTER ({m} > 0)", f"avg(CASE WHEN {m} > 0 THEN ln({m}) END)") for m in inputs.MEASURES))
def zero_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either handling of zeros does to each measure."""
    long = inputs.measures(spark, sf_dir).unpivot(["addr_key"], list(inputs.MEASURES), "measure", "v")
    return long.groupBy("measure").agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0).alias("n_zero"), F.round(F.avg(F.when(F.col("v") > 0, F.ln("v"))), 6).alias("mean_log"), F.round(F.avg(F.ln(F.col("v") + 1)), 6).alias("mean_log_plus"))


@query(f"{BASE} SELECT round(regr_slope(v, (x1 - (SELECT avg(x1) FROM sample)) / (SELECT stddev_samp(x1) FROM sample)), 6) AS refit, round(regr_slope(v, x1) * stddev_samp(x1), 6) AS analytic FROM sample")
def standardised_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope on z-scores, fitted again and from the raw slope."""
    d = sample(spark, sf_dir)
    m = d.agg(F.avg("x1").alias("m"), F.stddev_samp("x1").alias("s"))
    z = d.crossJoin(F.broadcast(m)).withColumn("z", (F.col("x1") - F.col("m")) / F.col("s"))
    return z.agg(F.round(F.regr_slope("v", "z"), 6).alias("refit"), F.round(F.regr_slope("v", "x1") * F.stddev_samp("x1"), 6).alias("analytic"))


@query("SELECT type, n, m, w, k, concat(type, '/', m, '/', w, '/', CAST(k AS VARCHAR)) AS job FROM (SELECT c_mktsegment AS type, count(*) AS n FROM customer GROUP BY 1), (SELECT unnest(['pc1', 'pc2', 'cc', 'bc', 'fk']) AS m), (SELECT unnest(['knn', 'band']) AS w), (SELECT unnest(range(4, 13, 4)) AS k)")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each type in the layer, measure, kind of weights and number of neighbours, with the rows that it will have."""
    out = inputs.layer(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    for name, values in (("m", inputs.MEASURES), ("w", ("knn", "band")), ("k", (4, 8, 12))):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.withColumn("k", F.col("k").cast("long")).withColumn("job", F.concat_ws("/", "type", "m", "w", F.col("k").cast("string")))


@query()
def hashed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.folds(sample(spark, sf_dir), "id", 10, 43).groupBy("fold").agg(F.count("*").alias("n"))
