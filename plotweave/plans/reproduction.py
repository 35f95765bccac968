"""Queries on nearest segments and on how one run reproduces another. The SQL compares every point with every segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lattice as lt, reproduce, segments as sg
from . import inputs
from .inputs import PT, SG
from .register import query
from .spatial import EXTENT, grid, sql_assign
from .validation import _CMP, compared

_T = "CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0::DOUBLE ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0::DOUBLE), 1.0::DOUBLE) END"
NEAREST = f"WITH {PT}, {SG}, m AS (SELECT id AS q_id, min(sqrt(pow(x - (x1 + {_T} * (x2 - x1)), 2) + pow(y - (y1 + {_T} * (y2 - y1)), 2))) AS d FROM pt, sg GROUP BY 1), p AS (SELECT id AS q_id, seg AS r_id, mass, sqrt(pow(x - (x1 + {_T} * (x2 - x1)), 2) + pow(y - (y1 + {_T} * (y2 - y1)), 2)) AS d FROM pt, sg), n AS (SELECT p.q_id, r_id, mass, p.d, row_number() OVER (PARTITION BY p.q_id ORDER BY r_id) AS nth, count(*) OVER (PARTITION BY p.q_id) > 1 AS tied FROM p JOIN m ON m.q_id = p.q_id AND m.d = p.d)"


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.nearest_segments(inputs.points(spark, sf_dir), inputs.segments(spark, sf_dir))


@query(f"{NEAREST} SELECT q_id, r_id, round(d, 6) AS d, tied FROM n")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapped(spark, sf_dir).select("q_id", "r_id", F.round("d", 6).alias("d"), "tied")


@query(f"{NEAREST} SELECT count(*) AS n, count(*) FILTER (tied) AS n_tied, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS most FROM n WHERE nth = 1")
def segment_snap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sg.snap_statistics(snapped(spark, sf_dir))
    return s.select("n", "n_tied", *(F.round(c, 6).alias(c) for c in ("median", "p90", "most")))


@query(f"{NEAREST} SELECT q_id, mass < 80 AS covered, CASE WHEN mass < 80 THEN mass END AS mass FROM n WHERE nth = 1")
def point_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant network has lost the segments of large mass."""
    return sg.point_coverage(snapped(spark, sf_dir), inputs.segments(spark, sf_dir).where("mass < 80"), "mass")


@query(f"{NEAREST}, o AS (SELECT n.*, CASE WHEN n.q_id % 5 = 0 THEN f.mass + 1 ELSE f.mass END AS a FROM n JOIN (SELECT q_id, mass FROM n WHERE nth = 1) f ON f.q_id = n.q_id), k AS (SELECT *, (a = 0 AND mass = 0) OR coalesce(abs(a - mass) / nullif(abs(mass), 0) < 1e-9, FALSE) AS e, (a = 0 AND mass = 0) OR coalesce(abs(a - mass) / nullif(abs(mass), 0) < 0.05, FALSE) AS w FROM o), g AS (SELECT q_id, bool_or(nth = 1 AND e) AS e, bool_or(nth = 1 AND w) AS w, bool_or(w) AS best, bool_or(tied) AS tied, bool_or(a = 0) AS zero FROM k GROUP BY 1) SELECT 'frozen' AS measure, 'mass' AS segment_column, count(*) AS n, round(avg(e::INTEGER), 9) AS exact, round(avg(w::INTEGER), 9) AS within, round(avg(best::INTEGER), 9) AS within_best_of_ties, count(*) FILTER (NOT w) AS fails, count(*) FILTER (NOT w AND tied) AS fails_at_tie, count(*) FILTER (NOT w AND zero) AS fails_zero FROM g")
def point_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen measures are those of the nearest segment, each fifth off by one."""
    near, seg = snapped(spark, sf_dir), inputs.segments(spark, sf_dir)
    own = near.where("nth = 1").join(seg.select(F.col("seg").alias("r_id"), "mass"), "r_id").selectExpr("q_id AS id", "IF(q_id % 5 = 0, mass + 1, mass) AS frozen")
    out = reproduce.point_reproduction(own, near, seg, ["frozen"], ["mass"], 1e-9, 0.05)
    return out.withColumns({c: F.round(c, 9) for c in ("exact", "within", "within_best_of_ties")})


_MID = f"WITH {SG}, pt AS (SELECT seg AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM sg), {sql_assign()}, q AS (SELECT a.cell, seg, mass, x2 - x1 AS wide FROM a JOIN sg ON sg.seg = a.id WHERE a.cell IS NOT NULL)"


def at_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = inputs.segments(spark, sf_dir).selectExpr("seg", "mass", "x2 - x1 AS wide", "(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y")
    return lt.assign(mid, grid()).where("cell IS NOT NULL").select("cell", "seg", "mass", "wide")


_REL = "CASE WHEN c = 0 AND r = 0 THEN 0.0::DOUBLE WHEN r = 0 THEN 'inf'::DOUBLE ELSE abs(c - r) / abs(r) END"


@query(f"{_MID}, g AS (SELECT cell, sum(mass) AS mass, sum(wide) AS wide, median(mass) AS mmass, median(wide) AS mwide FROM q GROUP BY 1), z AS (SELECT cell, 'mass_sum' AS frozen_column, 'sum' AS aggregation, mass + length(cell) % 2 AS r FROM g UNION ALL SELECT cell, 'wide_median', 'median', mwide FROM g), s AS (SELECT cell, 'sum' AS aggregation, 'mass' AS segment_column, mass AS c FROM g UNION ALL SELECT cell, 'sum', 'wide', wide FROM g UNION ALL SELECT cell, 'median', 'mass', mmass FROM g UNION ALL SELECT cell, 'median', 'wide', mwide FROM g), e AS (SELECT z.frozen_column, z.aggregation, s.segment_column, {_REL} AS rel FROM z JOIN s ON s.cell = z.cell AND s.aggregation = z.aggregation) SELECT frozen_column, aggregation, segment_column, count(*) AS n, round(avg((rel <= 1e-9)::INTEGER), 9) AS exact, round(avg((rel <= 0.05)::INTEGER), 9) AS within FROM e GROUP BY 1, 2, 3")
def cell_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen cells are the sums of mass, some off by one, and the median widths."""
    q = at_middle(spark, sf_dir)
    frozen = q.groupBy("cell").agg((F.sum("mass") + F.length("cell") % 2).alias("mass_sum"), F.median("wide").alias("wide_median"))
    out = reproduce.cell_reproduction(q, ["mass", "wide"], frozen, 1e-9, 0.05)
    return out.withColumns({c: F.round(c, 9) for c in ("exact", "within")})


@query(f"{_MID}, i AS (SELECT cell FROM cells WHERE r BETWEEN 0 AND 20 AND c BETWEEN 0 AND 23 AND cy >= 0), t AS (SELECT cell, count(*) AS n FROM q WHERE length(cell) <> 4 GROUP BY 1), w AS (SELECT 'middle' AS rule, cell, count(*) AS got FROM q GROUP BY 2 UNION ALL SELECT 'wide', cell, count(*) FROM q WHERE wide > 0 GROUP BY 2), x AS (SELECT u.rule, i.cell, t.n, coalesce(w.got, 0) AS got FROM i CROSS JOIN (VALUES ('middle'), ('wide')) u(rule) LEFT JOIN t ON t.cell = i.cell LEFT JOIN w ON w.cell = i.cell AND w.rule = u.rule) SELECT x.rule, CAST(sum(got) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS target_pairs, count(*) FILTER (coalesce(got = n, got = 0)) AS cells_exact, count(*) AS cells_total, round(avg(coalesce(got = n, got = 0)::INTEGER), 9) AS cells_exact_share, max(abs(got - n)) AS most, CASE WHEN x.rule = 'middle' THEN (SELECT count(DISTINCT seg) FROM q) ELSE (SELECT count(DISTINCT seg) FROM q WHERE wide > 0) END AS segments FROM x GROUP BY x.rule")
def cell_count_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = at_middle(spark, sf_dir)
    pairs = q.select(F.lit("middle").alias("rule"), "seg", "cell").union(q.where("wide > 0").select(F.lit("wide"), "seg", "cell"))
    target = q.where("length(cell) <> 4").groupBy("cell").agg(F.count("*").alias("n"))
    out = reproduce.cell_counts(pairs, grid().cells(spark, EXTENT, EXTENT), target, ["middle", "wide"])
    return out.withColumn("cells_exact_share", F.round("cells_exact_share", 9))


@query(f"{_CMP}, v AS (SELECT CASE WHEN addr_key % 10 = 0 THEN 0 ELSE c END AS a, CASE WHEN addr_key % 15 = 0 THEN 0 ELSE r END AS b FROM e), k AS (SELECT *, a > 0 AS za, b > 0 AS zb, CASE WHEN a > 0 AND b > 0 THEN abs(a - b) / b END AS rel FROM v) SELECT count(*) AS n_rows, count(*) FILTER (za) AS n_rebuilt, count(*) FILTER (zb) AS n_reference, round(avg((za = zb)::INTEGER), 9) AS zone_set_agreement, count(*) FILTER (za AND NOT zb) AS n_only_rebuilt, count(*) FILTER (zb AND NOT za) AS n_only_reference, round(avg((rel < 1e-3)::INTEGER), 9) AS within_01pct, round(avg((rel < 1e-2)::INTEGER), 9) AS within_1pct, round(quantile_cont(rel, 0.9), 9) AS p90_rel, round(quantile_cont(rel, 0.99), 9) AS p99_rel, round(max(rel), 9) AS max_rel, count(*) FILTER (rel >= 1e-2) AS n_above, round((sum(a) - sum(b)) / sum(b), 9) AS total_rel, round(coalesce(sum(b) FILTER (rel >= 1e-2), 0) / sum(b), 9) AS area_share_above FROM k")
def area_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = compared(spark, sf_dir).selectExpr("IF(addr_key % 10 = 0, 0D, c) AS a", "IF(addr_key % 15 = 0, 0D, r) AS b")
    out = reproduce.area_score(v, "a", "b")
    return out.withColumns({c: F.round(c, 9) for c in ("zone_set_agreement", "within_01pct", "within_1pct", "p90_rel", "p99_rel", "max_rel", "total_rel", "area_share_above")})


@query("SELECT c_mktsegment AS type, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_determinate, count(*) - count(*) FILTER (c_acctbal > 0) AS n_dropped, round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 0) / count(*), 9) AS pct_determinate FROM customer GROUP BY 1")
def determinacy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reproduce.determinacy(inputs.layer(spark, sf_dir), "type", F.col("area") > 0)
    return out.withColumn("pct_determinate", F.round("pct_determinate", 9))


_VARIANT = ("CASE WHEN mass = 7 THEN mass + 0.5 ELSE mass END AS mass", "CASE WHEN mass = 11 THEN x1 + 1 ELSE x1 END AS x1", "y1", "x2", "y2")
_SAME = "r.x1 = v.x1 AND r.y1 = v.y1 AND r.x2 = v.x2 AND r.y2 = v.y2"


@query(f"WITH {SG}, v AS (SELECT seg, {', '.join(_VARIANT)} FROM sg WHERE mass < 80 UNION ALL SELECT 'new', 1.0, 0.0, 0.0, 0.0, 0.0), j AS (SELECT r.seg IS NULL AS missing, abs(v.mass - r.mass) AS d, coalesce({_SAME}, FALSE) AS same FROM v LEFT JOIN sg r ON r.seg = v.seg), a AS (SELECT count(*) AS segments, count(*) FILTER (missing) AS missing, CAST(coalesce(max(d), 0) AS DOUBLE) AS max_length_diff, count(*) FILTER (same) AS same_geometry FROM j) SELECT *, missing = 0 AND max_length_diff = 0 AND same_geometry = segments AS ok FROM a")
def subgraph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant that lost segments of large mass, has some of another length or place, and one that the reference lacks."""
    all_ = inputs.segments(spark, sf_dir)
    more = spark.range(1).selectExpr("'new' AS seg", "1D AS mass", *(f"0D AS {c}" for c in sg.ENDS))
    variant = all_.where("mass < 80").selectExpr("seg", *_VARIANT)
    return reproduce.strict_subgraph(variant.unionByName(more), all_, ["seg"], "mass", list(sg.ENDS))


@query("WITH l AS (SELECT l_returnflag AS level, avg(l_quantity) AS a, avg(CAST(round(l_discount * 100) AS BIGINT)) AS b, avg(CAST(round(l_tax * 100) AS BIGINT)) AS c, avg(l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT level, a >= greatest(b, c, d) AS is_first, least(a, b) > greatest(c, d) AS access_beats FROM l")
def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundred = lambda c: F.avg(F.round(F.col(c) * 100).cast("long"))
    wide = inputs.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("level")).agg(F.avg("l_quantity").alias("PC1"), hundred("l_discount").alias("PC2"), hundred("l_tax").alias("BC"), F.avg("l_linenumber").alias("FK"))
    long = reproduce._long(wide, ["level"], ["PC1", "PC2", "BC", "FK"], "measure", "value")
    return reproduce.claim_flags(long, "level", "measure", "value", "PC1", ["PC1", "PC2"], ["BC", "FK"])


@query("SELECT concat('page/', page_id) AS path, 'checksum differs' AS fault FROM pages WHERE page_id % 11 = 0 UNION ALL SELECT 'page/absent', 'missing'")
def checksum_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all pages, each eleventh taken before a change, and of one page that is gone."""
    files = inputs.read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), "page_id", F.col("html").alias("content"))
    sums = files.select("path", F.sha2(F.when(F.col("page_id") % 11 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")).cast("binary"), 256).alias("digest"))
    sums = sums.union(spark.range(1).selectExpr("'page/absent'", "sha2('', 256)"))
    return reproduce.verify_sums(sums, files)
