"""Queries of rankings, the choice rule and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rank
from . import inputs
from .inputs import ME
from .register import query

#: Results by market segment and measure: the correlation-like share of each measure's total that a segment holds.
_LONG = f"WITH {ME}, l AS (" + " UNION ALL ".join(f"SELECT c_mktsegment AS seg, '{m}' AS measure, round(avg({m}) / (SELECT avg({m}) FROM me), 9) AS v FROM me JOIN customer ON c_custkey = addr_key GROUP BY 1" for m in inputs.MEASURES) + ")"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    me = inputs.measures(spark, sf_dir).join(inputs.layer(spark, sf_dir).select("addr_key", F.col("type").alias("seg")), "addr_key")
    means = me.agg(*(F.avg(m).alias(f"t_{m}") for m in inputs.MEASURES))
    per = me.groupBy("seg").agg(*(F.avg(m).alias(m) for m in inputs.MEASURES)).crossJoin(F.broadcast(means))
    return per.select("seg", *(F.round(F.col(m) / F.col(f"t_{m}"), 9).alias(m) for m in inputs.MEASURES)).unpivot(["seg"], list(inputs.MEASURES), "measure", "v")


@query(f"{_LONG} SELECT seg, measure, v, CAST(rank() OVER (PARTITION BY seg ORDER BY v DESC) AS INTEGER) AS rank FROM l")
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank_by(results(spark, sf_dir), ["seg"], "v")


@query(f"{_LONG} SELECT seg, string_agg(measure, ' > ' ORDER BY v DESC, measure) AS \"order\" FROM l GROUP BY seg")
def order_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.order_string(results(spark, sf_dir), ["seg"], "measure", "v")


#: A sweep over eight k and five measures, made of order totals.
_SWEEP = "WITH sw AS (SELECT 'cells' AS level, o_custkey % 8 + 1 AS k, o_custkey % 5 AS measure, avg(CAST(round(o_totalprice) AS BIGINT)) - (SELECT avg(CAST(round(o_totalprice) AS BIGINT)) FROM orders) AS beta, CAST(sum(o_orderkey) % 97 AS DOUBLE) / 500 AS p, CAST(sum(o_custkey) % 361 AS DOUBLE) / 200 - 0.9 AS rho, CAST(sum(o_orderkey) % 101 AS DOUBLE) / 100 AS lag FROM orders GROUP BY 2, 3)"


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("long").alias("price"))
    mean = o.agg(F.avg("price").alias("m"))
    per = o.groupBy((F.col("o_custkey") % 8 + 1).alias("k"), (F.col("o_custkey") % 5).alias("measure")).agg(F.avg("price").alias("b"), ((F.sum("o_orderkey") % 97).cast("double") / 500).alias("p"), ((F.sum("o_custkey") % 361).cast("double") / 200 - 0.9).alias("rho"), ((F.sum("o_orderkey") % 101).cast("double") / 100).alias("lag"))
    return per.crossJoin(F.broadcast(mean)).select(F.lit("cells").alias("level"), "k", "measure", (F.col("b") - F.col("m")).alias("beta"), "p", "rho", "lag")


@query(f"""{_SWEEP}, n AS (SELECT *, lead(beta) OVER w AS nb, lead(p) OVER w AS np FROM sw WINDOW w AS (PARTITION BY level, measure ORDER BY k)),
g AS (SELECT level, k, bool_and(abs(rho) < 0.9 - 1e-6 AND lag < 1) AS interior, count(*) FILTER (abs(abs(rho) - 0.9) < 1e-6) AS n_at_bound, count(nb) AS n_next, count(*) FILTER (sign(beta) <> sign(nb) AND (p < 0.05 OR np < 0.05)) AS n_flips, bool_and((p < 0.05) = (np < 0.05)) AS sig_ok, bool_and(sign(beta) = sign(nb)) AS sign_ok FROM n GROUP BY level, k),
r AS (SELECT level, k, lead(k) OVER (PARTITION BY level ORDER BY k) AS next_k, interior, n_at_bound, n_flips, CASE WHEN n_next > 0 THEN sig_ok AND n_flips = 0 END AS stable, CASE WHEN n_next > 0 THEN sig_ok AND sign_ok END AS stable_all, CASE WHEN n_next > 0 THEN interior AND sig_ok AND n_flips = 0 END AS satisfied FROM g)
SELECT a.*, (SELECT bool_and(b.interior) FROM r b WHERE b.level = a.level AND b.k >= a.k) AS interior_above, coalesce((SELECT bool_and(b.satisfied) FROM r b WHERE b.level = a.level AND b.k >= a.k), FALSE) AS holds_from_k FROM r a""")
def choice_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.choice_rule(sweep(spark, sf_dir))


@query(f"{_LONG}, w AS (SELECT seg, " + ", ".join(f"max(v) FILTER (measure = '{m}') AS {m}" for m in inputs.MEASURES) + " FROM l GROUP BY seg), r AS (SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS r_{m}" for m in inputs.MEASURES) + " FROM w) " + " UNION ALL ".join(f"SELECT '{m}' AS variant, round(corr(r_pc1, r_{m}), 6) AS spearman, max_by(seg, pc1) = max_by(seg, {m}) AS same_top FROM r" for m in inputs.MEASURES[1:]))
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rank.wide(results(spark, sf_dir), ["seg"], "measure", inputs.MEASURES, ["v"]).withColumnsRenamed({f"v_{m}": m for m in inputs.MEASURES})
    return rank.rank_agreement(w, "pc1", inputs.MEASURES[1:], "seg").withColumn("spearman", F.round("spearman", 6))


@query(f"{_SWEEP} SELECT a.measure, a.k, sign(a.beta) <> sign(b.beta) AS sign_changed, (a.p < 0.05) <> (b.p < 0.05) AS sig_changed, sign(a.beta) <> sign(b.beta) OR (a.p < 0.05) <> (b.p < 0.05) AS verdict_changed, (sign(a.beta) <> sign(b.beta) OR (a.p < 0.05) <> (b.p < 0.05)) AND (a.p < 0.05 OR b.p < 0.05) AS verdict_changed_on_significant FROM sw a JOIN sw b ON a.measure = b.measure AND b.k = 1 WHERE a.k <> 1")
def verdict_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.verdict_changes(sweep(spark, sf_dir), ["measure"], "k", 1)


@query(f"{_SWEEP} SELECT k, " + ", ".join(f"round(max(beta) FILTER (measure = {m}), 6) AS beta_{m}, max(p) FILTER (measure = {m}) AS p_{m}" for m in range(5)) + " FROM sw GROUP BY k")
def wide_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.wide(sweep(spark, sf_dir).withColumn("beta", F.round("beta", 6)), ["k"], "measure", range(5), ["beta", "p"])


@query(f"{_SWEEP}, g AS (SELECT k, measure FROM (SELECT unnest(range(1, 11)) AS k), (SELECT unnest(range(0, 6)) AS measure)) SELECT g.k, g.measure, round(beta, 6) AS beta, beta IS NULL AS missed FROM g LEFT JOIN sw ON sw.k = g.k AND sw.measure = g.measure")
def expected_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1, 11).withColumnRenamed("id", "k").crossJoin(spark.range(6).withColumnRenamed("id", "measure"))
    out = rank.complete(grid, sweep(spark, sf_dir).select("k", "measure", F.round("beta", 6).alias("beta")), ["k", "measure"])
    return out.withColumn("missed", F.col("beta").isNull())


@query(f"{_SWEEP} SELECT k, measure, statistic, round(value, 6) AS value FROM sw UNPIVOT (value FOR statistic IN (beta, p, rho, lag))")
def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.long(sweep(spark, sf_dir).drop("level"), ["k", "measure"], ["beta", "p", "rho", "lag"]).withColumn("value", F.round("value", 6))


@query("SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, count(*) FILTER (o_totalprice > 200000) AS n_above FROM orders GROUP BY o_orderpriority")
def quantile_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("o_totalprice", [0.1, 0.5, 0.9])
    return inputs.read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), *(F.round(q[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))), F.count_if(F.col("o_totalprice") > 200000).alias("n_above"))


