"""Queries that score results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import derive, profile, rank, validate
from . import inputs
from .derived import FROZEN, value_of, with_frozen
from .inputs import ME, PT, SG
from .register import query

_REL = "CASE WHEN c = 0 AND r = 0 THEN 0.0::DOUBLE WHEN r = 0 THEN 'inf'::DOUBLE ELSE abs(c - r) / abs(r) END"
_CMP = f"WITH {ME}, d AS (SELECT addr_key, pc2 - pc2 % 40 AS r, CASE WHEN addr_key % 9 = 0 THEN pc2 ELSE pc2 - pc2 % 40 END AS c FROM me), e AS (SELECT *, {_REL} AS rel FROM d)"


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference and a candidate that differs from it for each ninth key."""
    base = "pc2 - pc2 % 40"
    return inputs.measures(spark, sf_dir).selectExpr("addr_key", f"{base} AS r", f"CASE WHEN addr_key % 9 = 0 THEN pc2 ELSE {base} END AS c")


@query(f"{_CMP} SELECT count(*) AS n, round(avg(CAST(rel <= 1e-9 AS INTEGER)), 9) AS exact, round(avg(CAST(rel <= 0.01 AS INTEGER)), 9) AS within, round(median(rel) FILTER (rel < 'inf'::DOUBLE), 9) AS median_rel, round(median(c / nullif(r, 0)), 9) AS median_ratio FROM e")
def match_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compared(spark, sf_dir).agg(*validate.match_shares(F.col("c"), F.col("r"), 1e-9, 0.01))
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"{_CMP}, s AS (SELECT count(*) AS n_common, round(avg(CAST(rel <= 1e-9 AS INTEGER)), 9) AS exact, round(avg(CAST(rel <= 0.001 AS INTEGER)), 9) AS within_tight, round(avg(CAST(rel <= 0.05 AS INTEGER)), 9) AS within_wide, round(max(rel) FILTER (rel < 'inf'::DOUBLE), 9) AS max_rel, round(corr(c, r), 6) AS pearson, count(*) FILTER (r = 0) AS n_ref_zero, round(avg(CAST(c = 0 AS INTEGER)) FILTER (r = 0), 9) AS zero_agree FROM e) SELECT *, CASE WHEN n_common = 0 THEN 'FAIL' WHEN within_tight >= 0.99 THEN 'PASS' WHEN within_wide >= 0.9 THEN 'PASS WITH WARNING' ELSE 'FAIL' END AS verdict FROM s")
def acceptance_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.acceptance(validate.series_agreement(compared(spark, sf_dir), "c", "r", 1e-9, 0.001, 0.05), 0.99, 0.9)
    return s.withColumns({c: F.round(c, 6 if c == "pearson" else 9) for c in ("exact", "within_tight", "within_wide", "max_rel", "pearson", "zero_agree")})


_GATE = "WITH act AS (SELECT o_orderstatus AS level, o_orderpriority AS measure, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_orderpriority <> '3-MEDIUM' OR o_orderstatus <> 'P' GROUP BY 1, 2), exp AS (SELECT l AS level, m AS measure, CASE WHEN m = '5-LOW' THEN NULL ELSE (SELECT round(avg(o_totalprice), 4) FROM orders) END AS target FROM (SELECT DISTINCT o_orderstatus AS l FROM orders), (SELECT DISTINCT o_orderpriority AS m FROM orders)), g AS (SELECT exp.level, exp.measure, target, value, round(value - target, 4) AS delta, coalesce(abs(value - target) <= greatest(0.005, 0.01 * abs(target)), FALSE) AS within_tol, target IS NOT NULL AS scored FROM exp LEFT JOIN act ON act.level = exp.level AND act.measure = exp.measure)"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("measure"), "o_totalprice")
    act = o.where("measure <> '3-MEDIUM' OR level <> 'P'").groupBy("level", "measure").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    exp = o.select("level").distinct().crossJoin(o.select("measure").distinct()).crossJoin(F.broadcast(o.agg(F.round(F.avg("o_totalprice"), 4).alias("t")))).select("level", "measure", F.when(F.col("measure") != "5-LOW", F.col("t")).alias("target"))
    return validate.gate(exp, act, ["level", "measure"]).withColumn("delta", F.round("delta", 4))


@query(f"{_GATE} SELECT * FROM g")
def gate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


@query(f"{_GATE} SELECT level, count(*) FILTER (scored) AS n_scored, count(*) FILTER (scored AND within_tol) AS n_hit, count(*) FILTER (scored AND value IS NULL) AS n_absent FROM g GROUP BY level")
def gate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tally(gated(spark, sf_dir), ["level"])


@query("WITH t AS (SELECT o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS value, CAST((SELECT count(*) FROM orders) / 5 AS DOUBLE) AS target FROM orders GROUP BY 1) SELECT name, value, round(target, 6) AS target, CASE WHEN abs(value - target) <= 0.02 * abs(target) THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM t")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.read(spark, sf_dir, "orders")
    n = o.agg((F.count("*") / 5).alias("target"))
    t = profile.value_counts(o, "o_orderpriority").select(F.col("o_orderpriority").alias("name"), F.col("n").cast("double").alias("value")).crossJoin(F.broadcast(n))
    return validate.reconcile(t, "value", "target", 0.02).withColumn("target", F.round("target", 6))


@query("WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem), b AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity < 50) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b")
def mapping_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = inputs.read(spark, sf_dir, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return validate.same_rows(a.select(*cols), a.where("l_quantity < 50").select(*cols))


@query(f"{FROZEN} SELECT count(*) AS n_both, 0::BIGINT AS n_one_side, round(max(abs(unit_value - frozen)), 6) AS max_unit_value FROM w")
def rerun_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = with_frozen(spark, sf_dir)
    other = value_of(spark, sf_dir, derive.Variant(statistic="median", sales="all"))
    out = validate.largest_difference(w.select("addr_key", "unit_value"), other.select("addr_key", "unit_value"), ["addr_key"], ["unit_value"])
    return out.withColumn("max_unit_value", F.round("max_unit_value", 6))


@query("WITH c AS (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation) SELECT d.name, c.n, d.declared, coalesce(c.n = d.declared, FALSE) AS ok FROM (VALUES ('orders', 15000::BIGINT), ('nation', 25::BIGINT), ('absent', 1::BIGINT)) d(name, declared) LEFT JOIN c ON c.name = d.name")
def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for t in ("orders", "nation"):
        one = inputs.read(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return validate.declared_counts(counts, {"orders": 15000, "nation": 25, "absent": 1})


@query("WITH p AS (SELECT CAST(page_id AS VARCHAR) AS k, sha256(html) AS d FROM pages), g AS (SELECT left(sha256(k), 3) AS g, count(*) AS n, sha256(string_agg(concat(k, d), '' ORDER BY k)) AS d FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(g, d), '' ORDER BY g)) AS digest FROM g")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.digest(inputs.read(spark, sf_dir, "pages"), "page_id", "html")


@query(f"{_CMP} SELECT addr_key, c, r, rel FROM e WHERE rel < 'inf'::DOUBLE ORDER BY rel DESC, addr_key LIMIT 20")
def worst_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numeric import rel_diff

    d = compared(spark, sf_dir).withColumn("rel", rel_diff(F.col("c"), F.col("r"))).where(F.col("rel") < float("inf"))
    return validate.worst(d, "rel", 20, "addr_key")


@query(f"WITH {SG}, l AS (SELECT seg, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM sg), p AS (SELECT seg AS id, CASE WHEN len > 2 THEN 2 + greatest(CAST(floor((len - 2) / 5) AS BIGINT) - 1, 0) ELSE 1 END AS n FROM l) SELECT id, n FROM p")
def sample_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = validate.sample_points(inputs.segments(spark, sf_dir).withColumnRenamed("seg", "id"))
    return p.groupBy("id").agg(F.count("*").alias("n"))


@query()
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order decides which of two close points stays; counted in both directions by the tests."""
    p = validate.thinned_samples(inputs.segments(spark, sf_dir).withColumnRenamed("seg", "id"))
    return p.groupBy("id").agg(F.count("*").alias("n"))


@query()
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.points(spark, sf_dir).withColumn("x", F.floor(F.col("x") / 500) * 500).withColumn("y", F.floor(F.col("y") / 500) * 500)
    return validate.jitter(p, "x", "y", "id").select("id", "x", "y")


@query(f"WITH {PT}, d AS (SELECT floor(x / 500) * 500 AS x, floor(y / 500) * 500 AS y, id, area FROM pt) SELECT x, y, count(*) AS n, round(avg(area), 6) AS mean, min(id) AS first FROM d GROUP BY x, y")
def collapsed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.points(spark, sf_dir).selectExpr("CAST(floor(x / 500) AS DOUBLE) * 500 AS x", "CAST(floor(y / 500) AS DOUBLE) * 500 AS y", "id", "area")
    return validate.collapse_points(p, "x", "y", "area", "id").withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def ordered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a stated order of levels."""
    n = profile.value_counts(inputs.read(spark, sf_dir, "orders"), "o_orderpriority")
    return rank.in_order(n, "o_orderpriority", ["3-MEDIUM", "1-URGENT", "5-LOW"])
