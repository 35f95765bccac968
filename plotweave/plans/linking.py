"""Queries of record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import link
from . import inputs
from .inputs import GEO, SG, TX, UN
from .register import query


@query(f"WITH {TX}, {UN} SELECT count(*) AS rows, count(*) FILTER (EXISTS (SELECT 1 FROM un WHERE un.addr_key = tx.addr_key)) AS rows_matched, count(DISTINCT addr_key) AS keys, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM un WHERE un.addr_key = tx.addr_key) THEN addr_key END) AS keys_matched FROM tx")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.match_rate(inputs.transactions(spark, sf_dir), inputs.units(spark, sf_dir), "addr_key")


@query(f"WITH {TX}, {GEO} SELECT addr_key, area, type FROM geo WHERE addr_key NOT IN (SELECT addr_key FROM tx)")
def join_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.failures(inputs.layer(spark, sf_dir).select("addr_key", "area", "type"), inputs.transactions(spark, sf_dir), "addr_key")


_MASKED = "CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE concat(left(n_name, n_nationkey % 4), '?', substr(n_name, n_nationkey % 4 + 2)) END"


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = inputs.read(spark, sf_dir, "nation")
    ends = inputs.read(spark, sf_dir, "part").select(F.regexp_replace("p_brand", ".$", "?").alias("q"))
    return nation.selectExpr(f"{_MASKED} AS q").union(ends), nation.select(F.col("n_name").alias("w")).union(inputs.read(spark, sf_dir, "part").select("p_brand"))


_WILD = f"WITH q AS (SELECT {_MASKED} AS q FROM nation UNION SELECT regexp_replace(p_brand, '.$', '?') FROM part), v AS (SELECT n_name AS w FROM nation UNION SELECT p_brand FROM part), h AS (SELECT q.q, count(v.w) AS n_hits, min(v.w) AS w FROM q LEFT JOIN v ON v.w LIKE replace(replace(q.q, '_', '\\_'), '?', '_') ESCAPE '\\' GROUP BY q.q)"


@query(f"{_WILD} SELECT q, n_hits, CASE WHEN n_hits = 1 THEN w END AS resolved FROM h")
def wildcard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _masked(spark, sf_dir)
    return link.wildcard_hits(q, v, "q", "w")


@query(f"{_WILD} SELECT h.q, CASE WHEN v.w IS NOT NULL THEN h.q WHEN n_hits = 1 THEN h.w END AS resolved, CASE WHEN v.w IS NOT NULL THEN 'exact' WHEN n_hits = 1 THEN 'wildcard' WHEN n_hits > 1 THEN 'ambiguous' ELSE 'unresolved' END AS flags FROM h LEFT JOIN v ON v.w = h.q")
def vocabulary_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = _masked(spark, sf_dir)
    return link.resolve(q, v, "q", "w")


@query("SELECT q, w AS nearest, CAST(distance AS BIGINT) AS distance FROM (SELECT q, w, levenshtein(q, w) AS distance, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, w), w) AS r FROM (SELECT DISTINCT c_mktsegment AS q FROM customer UNION SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT n_name AS w FROM nation)) WHERE r = 1")
def fuzzy_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = inputs.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("q")).union(inputs.read(spark, sf_dir, "part").select("p_brand"))
    return link.fuzzy_nearest(q, inputs.read(spark, sf_dir, "nation"), "q", "n_name")


@query(f"WITH {TX}, {UN}, b AS (SELECT l_orderkey AS tx_id, any_value(l_linenumber) AS line FROM un GROUP BY 1 HAVING count(*) = 1) SELECT tx.tx_id, addr_key, line FROM tx JOIN b ON b.tx_id = tx.tx_id")
def unique_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and their units where both have one row: transactions of a single order line."""
    return link.unambiguous_join(inputs.transactions(spark, sf_dir).select("tx_id", "addr_key"), inputs.units(spark, sf_dir).select(F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("line")), "tx_id")


@query(f"WITH {GEO}, {inputs.ME} SELECT geo.addr_key, area, pc2 FROM geo JOIN me ON me.addr_key = geo.addr_key")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.one_to_one(inputs.layer(spark, sf_dir).select("addr_key", "area"), inputs.measures(spark, sf_dir).select("addr_key", "pc2"), "addr_key")


def _ends(d: str = "") -> str:
    return f"CASE WHEN {d}x1 < {d}x2 OR ({d}x1 = {d}x2 AND {d}y1 <= {d}y2) THEN concat_ws('|', CAST({d}x1 AS BIGINT), CAST({d}y1 AS BIGINT), CAST({d}x2 AS BIGINT), CAST({d}y2 AS BIGINT)) ELSE concat_ws('|', CAST({d}x2 AS BIGINT), CAST({d}y2 AS BIGINT), CAST({d}x1 AS BIGINT), CAST({d}y1 AS BIGINT)) END"


@query(f"WITH {SG}, k AS (SELECT seg, {_ends()} AS k, count(*) OVER (PARTITION BY {_ends()}) AS n FROM sg) SELECT seg AS left_seg, seg AS right_seg FROM k WHERE n = 1")
def coord_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments found again by their ends after every one is turned around; ambiguous ends match nothing."""
    sg = inputs.segments(spark, sf_dir)
    turned = sg.select("seg", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    name, pairs = link.cascade(sg.select("seg", "x1", "y1", "x2", "y2"), turned, [("id", F.concat(F.lit("no-"), F.lit(None).cast("string"))), ("ends", link.end_key("x1", "y1", "x2", "y2"))])
    return pairs.select(F.col("left.seg").alias("left_seg"), F.col("right.seg").alias("right_seg"))


@query(f"WITH {TX}, {UN}, a AS (SELECT DISTINCT addr_key AS k FROM tx), b AS (SELECT DISTINCT addr_key AS k FROM un) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (b.k IS NULL) AS n_only_a, count(*) FILTER (a.k IS NULL) AS n_only_b FROM a FULL JOIN b ON a.k = b.k")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.set_overlap(inputs.transactions(spark, sf_dir), inputs.units(spark, sf_dir), "addr_key")


@query(f"WITH {TX}, {GEO} SELECT addr_key, tx_id, area, type, area * 2 AS twice FROM tx LEFT JOIN (SELECT addr_key, area, type FROM geo WHERE area > 0) USING (addr_key)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inputs.layer(spark, sf_dir).where("area > 0").select("addr_key", "area", "type")
    return link.lookup(inputs.transactions(spark, sf_dir).select("addr_key", "tx_id"), g, "addr_key").withColumn("twice", F.col("area") * 2)
