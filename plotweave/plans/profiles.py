"""Queries of data profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import derive, profile
from . import inputs
from .inputs import TX, UN
from .register import query


@query("SELECT coalesce(a.v, b.v, c.v) AS value, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS pages, coalesce(c.n, 0) AS docs FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT upper(left(regexp_extract(url, '//([^/]+)', 1), 1)) AS v, count(*) AS n FROM pages GROUP BY 1) b ON a.v = b.v FULL JOIN (SELECT upper(left(lang, 1)) AS v, count(*) AS n FROM documents GROUP BY 1) c ON coalesce(a.v, b.v) = c.v")
def category_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {
        "orders": inputs.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("v")),
        "pages": inputs.read(spark, sf_dir, "pages").select(F.upper(F.substring(F.regexp_extract("url", "//([^/]+)", 1), 1, 1)).alias("v")),
        "docs": inputs.read(spark, sf_dir, "documents").select(F.upper(F.substring("lang", 1, 1)).alias("v")),
    }
    return profile.crosstab(frames, "v")


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority")
def price_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.distribution(inputs.read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p25", "p75")})


_COLS = ("l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS n_blank, count(*) FILTER (trim(CAST({c} AS VARCHAR)) IN ('INDETERMINADO', 'NA', 'N')) AS n_code, count(*) FILTER (TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) = 0) AS n_zero, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ('', 'INDETERMINADO', 'NA', 'N') OR coalesce(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) = 0, FALSE)) AS n_any FROM lineitem" for c in _COLS))
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missingness(inputs.read(spark, sf_dir, "lineitem").select(*_COLS), _COLS, ("INDETERMINADO", "", "NA", "N"))


_SEL = {"all": "TRUE", "non_parking": "NOT parking", "non_parking_non_parent": "NOT parking AND NOT parent"}


@query(f"WITH {UN}, p AS (SELECT addr_key, " + ", ".join(f"count(*) FILTER ({e}) AS {n}" for n, e in _SEL.items()).replace(" AS all", ' AS "all"') + " FROM un GROUP BY addr_key) " + " UNION ALL ".join(f"SELECT '{n}' AS convention, CAST(sum(\"{n}\") AS BIGINT) AS rows, count(*) FILTER (\"{n}\" > 0) AS keys, round(avg(\"{n}\") FILTER (\"{n}\" > 0), 6) AS mean, median(\"{n}\") FILTER (\"{n}\" > 0) AS median, max(\"{n}\") AS most, count(*) FILTER (\"{n}\" = 0) AS dropped FROM p" for n in _SEL))
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unit_counts(inputs.units(spark, sf_dir), {n: derive.unit_selected(n) for n in _SEL}).withColumn("mean", F.round("mean", 6))


@query(f"WITH {TX}, a AS (SELECT addr_key, median(price) AS v FROM tx GROUP BY 1), b AS (SELECT addr_key, avg(price) AS v FROM tx GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (abs(a.v - b.v) <= 0.05 * abs(b.v)) AS n_agree, count(*) FILTER (NOT abs(a.v - b.v) <= 0.05 * abs(b.v)) AS n_conflict FROM a JOIN b ON a.addr_key = b.addr_key")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transactions(spark, sf_dir).groupBy("addr_key").agg(F.median("price").alias("m"), F.avg("price").alias("a"))
    return profile.source_agreement(tx.select("addr_key", F.col("m").alias("v")), tx.select("addr_key", F.col("a").alias("v")), "addr_key", "v", 0.05)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def top_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(inputs.read(spark, sf_dir, "part"), "p_type", 10)


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n) - count(*) AS BIGINT) AS repeats FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_counts(inputs.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
