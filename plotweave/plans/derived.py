"""Queries of the derived value, its variants and its exclusion funnel."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import is_close
from ..operators import derive, funnel
from . import inputs
from .inputs import GEO, ROW_KEY, TX, UN
from .register import query

VARIANTS = {"mean_main": derive.Variant(), "median_main": derive.Variant(statistic="median"), "mean_all": derive.Variant(sales="all", units="all"), "no_parents": derive.Variant(units="non_parking_non_parent")}


def sql_sales(v: derive.Variant, name: str = "s") -> str:
    sel = {"all": "TRUE", "non_parking": "NOT parking"}[v.sales]
    fn = {"mean": "avg", "median": "median"}[v.statistic]
    return f"{name} AS (SELECT addr_key, CASE WHEN count(*) FILTER ({sel}) > 0 THEN {fn}(price) FILTER ({sel}) ELSE {fn}(price) END AS price_stat, CASE WHEN count(*) FILTER ({sel}) > 0 THEN count(*) FILTER ({sel}) ELSE count(*) END AS n_tx, count(*) FILTER ({sel}) = 0 AS price_fallback FROM dtx GROUP BY addr_key)"


def sql_units(v: derive.Variant, name: str = "u") -> str:
    sel = {"all": "TRUE", "non_parking": "NOT parking", "non_parking_non_parent": "NOT parking AND NOT parent"}[v.units]
    return (
        f"{name}0 AS (SELECT addr_key, count(*) FILTER ({sel}) AS a, count(*) AS b, count(*) FILTER ({sel} AND parent) AS c, count(*) FILTER (parent) AS d FROM un GROUP BY addr_key), "
        f"{name} AS (SELECT addr_key, CASE WHEN a > 0 THEN a ELSE b END AS n_units_rows, CASE WHEN a > 0 THEN c ELSE d END AS n_units_parent, a = 0 AS unit_fallback FROM {name}0)"
    )


DTX = f"WITH {TX}, {UN}, {GEO}, dtx AS (SELECT DISTINCT addr_key, price, purpose, day, parking FROM tx)"


def sql_value(v: derive.Variant, tag: str = "") -> str:
    """CTEs ending in d{tag}: the derived value of a variant."""
    return (
        f"{sql_sales(v, 's' + tag)}, {sql_units(v, 'u' + tag)}, d{tag} AS (SELECT *, price_stat * n_units AS value, CASE WHEN area <> 0 THEN price_stat * n_units / area END AS unit_value, "
        "CASE WHEN n_tx IS NULL OR n_units IS NULL THEN 'S4_no_sale_or_no_units' WHEN n_units = 1 THEN 'S1_single_unit' WHEN n_tx = 1 THEN 'S2_multi_one_sale' ELSE 'S3_multi_several_sales' END AS scenario FROM "
        "(SELECT g.*, s.price_stat, s.n_tx, coalesce(s.price_fallback, FALSE) AS price_fallback, u.n_units_rows, u.n_units_parent, coalesce(u.unit_fallback, FALSE) AS unit_fallback, "
        "coalesce(u.n_units_rows > 1 AND u.n_units_rows = u.n_units_parent, FALSE) AS parent_only, CASE WHEN u.n_units_rows > 1 AND u.n_units_rows = u.n_units_parent THEN 1 ELSE u.n_units_rows END AS n_units "
        f"FROM geo g LEFT JOIN s{tag} s ON s.addr_key = g.addr_key LEFT JOIN u{tag} u ON u.addr_key = g.addr_key))"
    )


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tx = derive.dedupe(inputs.transactions(spark, sf_dir), ROW_KEY)
    return inputs.layer(spark, sf_dir), tx, inputs.units(spark, sf_dir)


def value_of(spark: SparkSession, sf_dir: str, v: derive.Variant = derive.Variant()) -> DataFrame:
    return derive.derived_value(*sources(spark, sf_dir), v)


@query(f"{DTX}, {sql_value(derive.Variant())} SELECT addr_key, round(price_stat, 6) AS price_stat, n_tx, n_units, n_units_rows, price_fallback, unit_fallback, parent_only, round(value, 4) AS value, round(unit_value, 6) AS unit_value, scenario FROM d")
def derived_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = value_of(spark, sf_dir)
    return d.select("addr_key", F.round("price_stat", 6).alias("price_stat"), "n_tx", "n_units", "n_units_rows", "price_fallback", "unit_fallback", "parent_only", F.round("value", 4).alias("value"), F.round("unit_value", 6).alias("unit_value"), "scenario")


def _variant_row(d: DataFrame, name: str) -> DataFrame:
    return d.agg(F.lit(name).alias("variant"), F.count("*").alias("n"), F.count("unit_value").alias("n_defined"), F.round(F.median("unit_value"), 6).alias("median_value"), F.count_if("price_fallback").alias("n_price_fallback"), F.count_if("unit_fallback").alias("n_unit_fallback"), F.count_if("parent_only").alias("n_parent_only"))


@query(DTX + ", " + ", ".join(sql_value(v, str(i)) for i, v in enumerate(VARIANTS.values())) + " " + " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) AS n, count(unit_value) AS n_defined, round(median(unit_value), 6) AS median_value, count(*) FILTER (price_fallback) AS n_price_fallback, count(*) FILTER (unit_fallback) AS n_unit_fallback, count(*) FILTER (parent_only) AS n_parent_only FROM d{i}" for i, n in enumerate(VARIANTS)))
def derived_value_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, v in VARIANTS.items():
        row = _variant_row(value_of(spark, sf_dir, v), name)
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{DTX}, {sql_value(derive.Variant())} SELECT scenario, count(*) AS n, count(unit_value) AS n_defined, round(avg(n_tx), 6) AS mean_tx, CAST(max(n_units) AS BIGINT) AS max_units, round(median(unit_value), 6) AS median_value FROM d GROUP BY scenario")
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_of(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("n"), F.count("unit_value").alias("n_defined"), F.round(F.avg("n_tx"), 6).alias("mean_tx"), F.max("n_units").alias("max_units"), F.round(F.median("unit_value"), 6).alias("median_value"))


def _funnel(order: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = value_of(spark, sf_dir).select("addr_key", "area", "unit_value").join(inputs.measures(spark, sf_dir), "addr_key", "left")
        steps = funnel.exclude(d, order, ["unit_value", "area", *inputs.MEASURES], "unit_value")
        return funnel.count_log(steps)

    return run


def _funnel_sql(order: list[str]) -> str:
    pos = " AND ".join(f"coalesce({c} > 0, FALSE)" for c in ("unit_value", "area", *inputs.MEASURES))
    ctes, last, rows = [f"f0 AS (SELECT d.addr_key, d.area, d.unit_value, me.* EXCLUDE (addr_key) FROM d LEFT JOIN me ON me.addr_key = d.addr_key)"], "f0", ["SELECT 0 AS position, 'loaded' AS step, count(*) AS n FROM f0"]
    for k, step in enumerate(order, 1):
        if step == "positivity":
            ctes.append(f"f{k} AS (SELECT * FROM {last} WHERE {pos})")
        else:
            ctes.append(f"q{k} AS (SELECT quantile_cont(unit_value, 0.25) AS a, quantile_cont(unit_value, 0.75) AS b FROM {last}), f{k} AS (SELECT {last}.* FROM {last}, q{k} WHERE unit_value >= a - 1.5 * (b - a) AND unit_value <= b + 1.5 * (b - a))")
        last = f"f{k}"
        rows.append(f"SELECT {k} AS position, '{step}' AS step, count(*) AS n FROM {last}")
    return f"{DTX}, {inputs.ME}, {sql_value(derive.Variant())}, {', '.join(ctes)}, l AS ({' UNION ALL '.join(rows)}) SELECT position, step, n, n - lag(n) OVER (ORDER BY position) AS delta FROM l"


@query(_funnel_sql(["positivity", "iqr_outliers"]))
def exclusion_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(["positivity", "iqr_outliers"])(spark, sf_dir)


@query(_funnel_sql(["iqr_outliers", "positivity"]))
def exclusion_funnel_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funnel(["iqr_outliers", "positivity"])(spark, sf_dir)


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey FROM orders, q WHERE o_totalprice >= a - 0.4 * (b - a) AND o_totalprice <= b + 0.4 * (b - a)")
def iqr_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.within_fence(inputs.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.4).select("o_orderkey")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.dedupe(inputs.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query(f"{DTX}, {sql_sales(derive.Variant(statistic='median'))} SELECT addr_key, round(price_stat, 6) AS price_stat, n_tx, price_fallback FROM s")
def fallback_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.sale_aggregates(sources(spark, sf_dir)[1], derive.Variant(statistic="median")).withColumn("price_stat", F.round("price_stat", 6))


@query(f"WITH {UN}, {sql_units(derive.Variant(units='all'))} SELECT addr_key, CASE WHEN n_units_rows > 1 AND n_units_rows = n_units_parent THEN 1 ELSE n_units_rows END AS n_units, n_units_rows, n_units_parent, n_units_rows > 1 AND n_units_rows = n_units_parent AS parent_only, unit_fallback FROM u")
def parent_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.unit_aggregates(inputs.units(spark, sf_dir), derive.Variant(units="all"))


@query(f"{DTX}, a AS (SELECT addr_key, count(*) AS n_tx_all, count(*) FILTER (parking) AS n_tx_parking, count(*) FILTER (trim(purpose) = '') AS n_tx_blank, min(price) AS price_min, max(price) AS price_max, count(DISTINCT purpose) AS n_purposes FROM dtx GROUP BY addr_key), b AS (SELECT addr_key, count(*) AS n_rows_all, count(*) FILTER (parking) AS n_rows_parking, count(*) FILTER (parent) AS n_rows_parent FROM un GROUP BY addr_key) SELECT coalesce(a.addr_key, b.addr_key) AS addr_key, a.* EXCLUDE (addr_key), b.* EXCLUDE (addr_key) FROM a FULL JOIN b ON a.addr_key = b.addr_key")
def descriptor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tx, un = sources(spark, sf_dir)
    return derive.key_descriptors(tx, un)


GRID = [derive.Variant(statistic=s, sales=a, units=u) for s, a, u in itertools.product(("mean", "median"), ("all", "non_parking"), ("all", "non_parking", "non_parking_non_parent"))]


@query(
    f"{DTX}, {sql_value(derive.Variant(), 'z')}, "
    + ", ".join(f"{sql_sales(v, f's{i}_')}, {sql_units(v, f'u{i}_')}" for i, v in enumerate(GRID))
    + " "
    + " UNION ALL ".join(
        f"SELECT '{v.statistic}/{v.sales}/{v.units}' AS convention, count(*) AS n, count(*) FILTER (abs(s.price_stat * CASE WHEN u.n_units_rows > 1 AND u.n_units_rows = u.n_units_parent THEN 1 ELSE u.n_units_rows END - z.value) <= 1e-8 + 1e-9 * abs(z.value)) AS n_exact, "
        f"count(*) FILTER (abs(s.price_stat * CASE WHEN u.n_units_rows > 1 AND u.n_units_rows = u.n_units_parent THEN 1 ELSE u.n_units_rows END - z.value) <= 1e-8 + 0.01 * abs(z.value)) AS n_within FROM dz z JOIN s{i}_ s ON s.addr_key = z.addr_key JOIN u{i}_ u ON u.addr_key = z.addr_key WHERE z.value IS NOT NULL"
        for i, v in enumerate(GRID)
    )
)
def convention_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every convention against the value of the first: all sums and counts of the grid come from two aggregations, then each convention picks its own."""
    _, tx, un = sources(spark, sf_dir)
    sale = tx.groupBy("addr_key").agg(*(derive.statistic(s, F.when(derive.sale_selected(a), F.col("price"))).alias(f"p_{s}_{a}") for s in ("mean", "median") for a in ("all", "non_parking")))
    unit = un.groupBy("addr_key").agg(*(c for u in ("all", "non_parking", "non_parking_non_parent") for c in (F.count_if(derive.unit_selected(u)).alias(f"n_{u}"), F.count_if(derive.unit_selected(u) & F.col("parent")).alias(f"q_{u}"))))

    def value(v: derive.Variant):
        n = F.when(F.col(f"n_{v.units}") > 0, F.col(f"n_{v.units}")).otherwise(F.col("n_all"))
        q = F.when(F.col(f"n_{v.units}") > 0, F.col(f"q_{v.units}")).otherwise(F.col("q_all"))
        return F.coalesce(F.col(f"p_{v.statistic}_{v.sales}"), F.col(f"p_{v.statistic}_all")) * F.when((n > 1) & (n == q), 1).otherwise(n)

    target = value(derive.Variant())
    own = sale.join(unit, "addr_key").join(inputs.layer(spark, sf_dir).select("addr_key"), "addr_key", "left_semi")
    grid = F.explode(F.array(*(F.struct(F.lit(f"{v.statistic}/{v.sales}/{v.units}").alias("convention"), is_close(value(v), target, 1e-9).alias("exact"), is_close(value(v), target, 0.01).alias("within")) for v in GRID)))
    return own.select(grid.alias("g")).groupBy("g.convention").agg(F.count("*").alias("n"), F.count_if("g.exact").alias("n_exact"), F.count_if("g.within").alias("n_within"))


def with_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived value beside a frozen one: that of the median over all sales."""
    other = value_of(spark, sf_dir, derive.Variant(statistic="median", sales="all")).select("addr_key", F.col("unit_value").alias("frozen"))
    return value_of(spark, sf_dir).join(other, "addr_key")


FROZEN = f"{DTX}, {sql_value(derive.Variant())}, {sql_value(derive.Variant(statistic='median', sales='all'), 'f')}, w AS (SELECT d.*, df.unit_value AS frozen FROM d JOIN df ON df.addr_key = d.addr_key), st AS (SELECT *, CASE WHEN unit_value IS NULL OR frozen IS NULL THEN 'undefined' WHEN abs(unit_value - frozen) <= 1e-8 + 1e-9 * abs(frozen) THEN 'exact' WHEN abs(unit_value - frozen) <= 1e-8 + 0.01 * abs(frozen) THEN 'within_tol' ELSE 'residual' END AS status FROM w)"


@query(f"{FROZEN} SELECT status, scenario, count(*) AS n FROM st GROUP BY status, scenario")
def record_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_frozen(spark, sf_dir)
    return d.withColumn("status", derive.record_status(F.col("unit_value"), F.col("frozen"))).groupBy("status", "scenario").agg(F.count("*").alias("n"))


MASKS = {"price_fallback": "price_fallback", "unit_fallback": "unit_fallback", "parent_only": "parent_only", "one_sale": "n_tx = 1", "many_sales": "n_tx > 2", "one_unit": "n_units = 1", "small_area": "area < 1000", "large_area": "area > 5000"}


@query(f"{FROZEN}, m AS (SELECT mask, status, flag FROM (SELECT status, " + ", ".join(f"coalesce({e}, FALSE) AS {n}" for n, e in MASKS.items()) + f" FROM st WHERE status <> 'undefined') UNPIVOT (flag FOR mask IN ({', '.join(MASKS)}))) SELECT mask, count(*) FILTER (flag) AS n_mask, count(*) FILTER (flag AND status = 'residual') AS n_residual, round(count(*) FILTER (flag AND status = 'residual') / nullif(count(*) FILTER (flag), 0)::DOUBLE / (count(*) FILTER (status = 'residual') / nullif(count(*), 0)::DOUBLE), 6) AS lift FROM m GROUP BY mask")
def residual_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often residual records show each attribute than all records do."""
    d = with_frozen(spark, sf_dir).withColumn("status", derive.record_status(F.col("unit_value"), F.col("frozen"))).where("status <> 'undefined'")
    long = d.select((F.col("status") == "residual").alias("bad"), F.explode(F.array(*(F.struct(F.lit(n).alias("mask"), F.coalesce(F.expr(e), F.lit(False)).alias("flag")) for n, e in MASKS.items()))).alias("m")).select("bad", "m.*")
    hit, bad = F.count_if("flag"), F.count_if(F.col("flag") & F.col("bad"))
    return long.groupBy("mask").agg(hit.alias("n_mask"), bad.alias("n_residual"), F.round(F.try_divide(bad, hit) / F.try_divide(F.count_if("bad"), F.count("*")), 6).alias("lift"))


@query(f"{FROZEN}, c AS (SELECT addr_key, list_contains(list(DISTINCT purpose), '1-URGENT') AS has FROM dtx GROUP BY addr_key), n AS (SELECT st.status, coalesce(c.has, FALSE) AS has, CASE WHEN sa.price_stat IS NOT NULL AND abs(CASE WHEN area <> 0 THEN sa.price_stat * n_units / area END - frozen) <= 1e-8 + 0.01 * abs(frozen) THEN TRUE ELSE FALSE END AS ok2, status IN ('exact', 'within_tol') AS ok1 FROM st LEFT JOIN c ON c.addr_key = st.addr_key LEFT JOIN sa ON sa.addr_key = st.addr_key WHERE status <> 'undefined') SELECT has AS has_urgent, count(*) AS n, count(*) FILTER (ok1) AS n_base, count(*) FILTER (ok2 AND NOT ok1) AS n_rescued, count(*) FILTER (ok1 AND NOT ok2) AS n_broken FROM n GROUP BY has".replace("st AS (", f"{sql_sales(derive.Variant(sales='all'), 'sa')}, st AS ("))
def rule_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule for keys with a given category would rescue and break against the base rule."""
    _, tx, _ = sources(spark, sf_dir)
    d = with_frozen(spark, sf_dir).withColumn("status", derive.record_status(F.col("unit_value"), F.col("frozen"))).where("status <> 'undefined'")
    per = tx.groupBy("addr_key").agg(F.array_contains(F.collect_set("purpose"), "1-URGENT").alias("has_urgent"), F.avg("price").alias("p2"))
    ok1 = F.col("status").isin("exact", "within_tol")
    ok2 = is_close(F.when(F.col("area") != 0, F.col("p2") * F.col("n_units") / F.col("area")), F.col("frozen"), 0.01)
    out = d.join(per, "addr_key", "left").select(F.coalesce("has_urgent", F.lit(False)).alias("has_urgent"), ok1.alias("a"), ok2.alias("b"))
    return out.groupBy("has_urgent").agg(F.count("*").alias("n"), F.count_if("a").alias("n_base"), F.count_if(F.col("b") & ~F.col("a")).alias("n_rescued"), F.count_if(F.col("a") & ~F.col("b")).alias("n_broken"))


@query(f"{FROZEN} SELECT addr_key, round(frozen * area / price_stat, 6) AS implied_units, round_even(frozen * area / price_stat, 0) AS implied_round, coalesce(abs(frozen * area / price_stat - round_even(frozen * area / price_stat, 0)) <= 1e-8 + 1e-3 * abs(round_even(frozen * area / price_stat, 0)), FALSE) AS implied_is_whole, round_even(frozen * area / price_stat, 0) - n_units AS units_delta FROM st WHERE status = 'residual'")
def residual_implied_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_frozen(spark, sf_dir).withColumn("status", derive.record_status(F.col("unit_value"), F.col("frozen"))).where("status = 'residual'")
    return derive.residual_flags(d).select("addr_key", F.round("implied_units", 6).alias("implied_units"), "implied_round", "implied_is_whole", "units_delta")


@query(f"{DTX}, t AS (SELECT addr_key, median(price) AS target FROM dtx GROUP BY addr_key), n AS (SELECT addr_key, count(*) AS n, list_sort(list(price)) AS p FROM dtx GROUP BY addr_key HAVING count(*) BETWEEN 2 AND 10), m AS (SELECT n.addr_key, n.n, p, target, unnest(range(1, (1 << n.n) - 1)) AS m FROM n JOIN t ON t.addr_key = n.addr_key), k AS (SELECT addr_key, n, target, list_filter(p, lambda x, i: (m >> (i - 1)) & 1 = 1) AS q FROM m) SELECT addr_key, n, bool_or(abs(list_sum(q) / len(q) - target) <= 1e-6 * abs(target)) AS hit FROM k GROUP BY addr_key, n")
def subset_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = sources(spark, sf_dir)[1]
    return derive.subset_hits(tx, tx.groupBy("addr_key").agg(F.median("price").alias("target")))


@query("SELECT c_custkey AS addr_key, sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (o_orderstatus <> 'P')::DOUBLE AS area_sum, count(*) FILTER (o_orderstatus = 'P') AS n_indeterminate, count(*) FILTER (o_orderstatus <> 'P') AS n_numeric, count(*) FILTER (o_orderstatus = 'P') = 0 AS all_counted_rows_numeric, count(*) FILTER (o_orderstatus <> 'P') > 0 AS any_row_numeric FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def built_area_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("addr_key"), F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice").cast("long")).alias("a"))
    out = derive.built_area(orders.join(inputs.layer(spark, sf_dir).select("addr_key"), "addr_key", "left_semi"), "a")
    return out.withColumn("area_sum", F.col("area_sum").cast("double")).drop("area_mean")


@query("SELECT a.o_custkey AS addr_key, a.o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders a, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def standardised_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores of a column; its two moments are one broadcast row."""
    orders = inputs.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("addr_key"), "o_orderkey", "o_totalprice")
    moments = orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return orders.crossJoin(F.broadcast(moments)).select("addr_key", "o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / F.col("s"), 6).alias("z"))


