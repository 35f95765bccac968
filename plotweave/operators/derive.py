"""The derived value: a price statistic times a unit count over an area, with fallbacks and scenarios.

Each side is one aggregation: the statistic over the selected rows and over all rows come out of the same pass, so a key
whose selection is empty falls back without a second scan or a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import is_close, safe_div

SCENARIOS = ("S4_no_sale_or_no_units", "S1_single_unit", "S2_multi_one_sale", "S3_multi_several_sales")


@dataclass(frozen=True)
class Variant:
    """statistic: mean or median; sales: all or non_parking; units: all, non_parking or non_parking_non_parent; blank: what a blank purpose is in a selection of sales; parents: whether parent rows count as units."""

    statistic: str = "mean"
    sales: str = "non_parking"
    units: str = "non_parking"
    blank: str = "keep_as_nonparking"
    parents: str = "include"
    fallback: str = "use_all_transactions"
    parent_only_as: str = "one"


def statistic(name: str, col: Column) -> Column:
    if name == "mean":
        return F.avg(col)
    if name == "median":
        return F.median(col)
    raise ValueError(f"unknown statistic: {name}")


def dedupe(df: DataFrame, keys: list[str], mode: str = "dedupe") -> DataFrame:
    """One row for each combination of the key columns, which alone are compared; or all rows."""
    if mode == "keep":
        return df
    if mode != "dedupe":
        raise ValueError(f"unknown handling of duplicates: {mode}")
    return df.dropDuplicates(keys)


def sale_selected(which: str, blank: str = "keep_as_nonparking") -> Column:
    """Whether a row of transactions takes part in the price."""
    if which not in ("all", "non_parking") or blank not in ("keep_as_nonparking", "drop"):
        raise ValueError(f"unknown selection of sales: {which}, {blank}")
    keep = F.lit(True) if which == "all" else ~F.col("parking")
    return keep if blank == "keep_as_nonparking" else keep & (F.coalesce(F.trim("purpose"), F.lit("")) != "")


def unit_selected(which: str, parents: str = "include") -> Column:
    """Whether a row of the registry counts as a unit."""
    if which not in ("all", "non_parking", "non_parking_non_parent") or parents not in ("include", "exclude"):
        raise ValueError(f"unknown selection of units: {which}, {parents}")
    keep = F.lit(True) if which == "all" else ~F.col("parking")
    return keep & ~F.col("parent") if which == "non_parking_non_parent" or parents == "exclude" else keep


def sale_aggregates(tx: DataFrame, v: Variant, key: str = "addr_key") -> DataFrame:
    """key, price_stat, n_tx, price_fallback."""
    sel = sale_selected(v.sales, v.blank)
    own = tx.groupBy(key).agg(F.count_if(sel).alias("n_sel"), F.count("*").alias("n_all"), statistic(v.statistic, F.when(sel, F.col("price"))).alias("p_sel"), statistic(v.statistic, F.col("price")).alias("p_all"))
    if v.fallback == "leave_undefined":
        return own.where("n_sel > 0").select(key, F.col("p_sel").alias("price_stat"), F.col("n_sel").alias("n_tx"), F.lit(False).alias("price_fallback"))
    if v.fallback != "use_all_transactions":
        raise ValueError(f"unknown fallback: {v.fallback}")
    some = F.col("n_sel") > 0
    return own.select(key, F.when(some, F.col("p_sel")).otherwise(F.col("p_all")).alias("price_stat"), F.when(some, F.col("n_sel")).otherwise(F.col("n_all")).alias("n_tx"), (~some).alias("price_fallback"))


def unit_aggregates(units: DataFrame, v: Variant, key: str = "addr_key") -> DataFrame:
    """key, n_units, n_units_rows, n_units_parent, parent_only, unit_fallback. A key whose selected rows are all parents, and more than one, is one plot."""
    sel = unit_selected(v.units, v.parents)
    own = units.groupBy(key).agg(F.count_if(sel).alias("n_sel"), F.count("*").alias("n_all"), F.count_if(sel & F.col("parent")).alias("q_sel"), F.count_if("parent").alias("q_all"))
    some = F.col("n_sel") > 0
    if v.fallback == "leave_undefined":
        own = own.where(some)
    rows = own.select(key, F.when(some, F.col("n_sel")).otherwise(F.col("n_all")).alias("n_units_rows"), F.when(some, F.col("q_sel")).otherwise(F.col("q_all")).alias("n_units_parent"), (~some).alias("unit_fallback"))
    only = (F.col("n_units_parent") == F.col("n_units_rows")) & (F.col("n_units_rows") > 1)
    collapsed = F.when(only, F.lit(1).cast("long")).otherwise(F.col("n_units_rows")) if v.parent_only_as == "one" else F.col("n_units_rows")
    return rows.select(key, collapsed.alias("n_units"), "n_units_rows", "n_units_parent", only.alias("parent_only"), "unit_fallback")


def scenario(n_tx: Column, n_units: Column) -> Column:
    none = n_tx.isNull() | (n_tx == 0) | n_units.isNull() | (n_units == 0)
    return F.when(none, SCENARIOS[0]).when(n_units == 1, SCENARIOS[1]).when((n_units > 1) & (n_tx == 1), SCENARIOS[2]).when((n_units > 1) & (n_tx > 1), SCENARIOS[3]).otherwise("unclassified")


def derived_value(layer: DataFrame, tx: DataFrame, units: DataFrame, v: Variant = Variant(), key: str = "addr_key") -> DataFrame:
    """``layer`` (key, area, ...) with the aggregates, value = price_stat * n_units, unit_value = value / area, and scenario."""
    out = layer.join(sale_aggregates(tx, v, key), key, "left").join(unit_aggregates(units, v, key), key, "left")
    no = F.lit(False)
    return out.withColumns({"price_fallback": F.coalesce("price_fallback", no), "unit_fallback": F.coalesce("unit_fallback", no), "parent_only": F.coalesce("parent_only", no), "value": F.col("price_stat") * F.col("n_units")}).withColumns(
        {"unit_value": safe_div(F.col("value"), F.col("area")), "scenario": scenario(F.col("n_tx"), F.col("n_units"))}
    )


def key_descriptors(tx: DataFrame, units: DataFrame, key: str = "addr_key") -> DataFrame:
    """What the audit of residuals needs of each key, from either side; counts are null where a side has no row."""
    a = tx.groupBy(key).agg(F.count("*").alias("n_tx_all"), F.count_if("parking").alias("n_tx_parking"), F.count_if(F.coalesce(F.trim("purpose"), F.lit("")) == "").alias("n_tx_blank"), F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.count_distinct("purpose").alias("n_purposes"))
    b = units.groupBy(key).agg(F.count("*").alias("n_rows_all"), F.count_if("parking").alias("n_rows_parking"), F.count_if("parent").alias("n_rows_parent"))
    return a.join(b, key, "full")


def record_status(value: Column, frozen: Column, rtol: float = 0.01, exact: float = 1e-9) -> Column:
    """exact, within_tol, residual or undefined."""
    return F.when(value.isNull() | frozen.isNull(), "undefined").when(is_close(value, frozen, exact), "exact").when(is_close(value, frozen, rtol), "within_tol").otherwise("residual")


def residual_flags(df: DataFrame) -> DataFrame:
    """implied_units (frozen value times area over the statistic), its nearest whole number (half to even), whether it is one, and how far the count is off."""
    implied = safe_div(F.col("frozen") * F.col("area"), F.col("price_stat"))
    return df.withColumn("implied_units", implied).withColumn("implied_round", F.rint("implied_units")).withColumns({"implied_is_whole": is_close(F.col("implied_units"), F.col("implied_round"), 1e-3), "units_delta": F.col("implied_round") - F.col("n_units")})


def subset_hits(tx: DataFrame, targets: DataFrame, key: str = "addr_key", most: int = 10, rtol: float = 1e-6) -> DataFrame:
    """key, n, hit: whether the mean of some strict, non-empty subset of a key's prices equals its target. Keys with more than ``most`` prices are left out, as the subsets double with each."""
    lists = tx.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("price")).alias("p")).where(F.col("n").between(2, most))
    member = "(shiftright(m, i) & 1) = 1"
    mean = f"aggregate(sequence(0, n - 1), struct(0D AS s, 0 AS k), (a, i) -> IF({member}, struct(a.s + p[int(i)] AS s, a.k + 1 AS k), a), a -> a.s / a.k)"
    mean = mean.replace("sequence(0, n - 1)", "sequence(0, int(n) - 1)")
    return lists.join(targets, key).withColumn("hit", F.expr(f"exists(sequence(1, shiftleft(1, int(n)) - 2), m -> abs({mean} - target) <= {rtol} * abs(target))")).select(key, F.col("n"), "hit")


def built_area(units: DataFrame, area: str, key: str = "addr_key") -> DataFrame:
    """Sum of the numeric areas (null if there is none), rows without one, rows with one, and both determinacy rules."""
    number = F.col(area)
    return units.groupBy(key).agg(F.sum(number).alias("area_sum"), F.count_if(number.isNull()).alias("n_indeterminate"), F.count(number).alias("n_numeric"), F.avg(number).alias("area_mean")).withColumns(
        {"all_counted_rows_numeric": F.col("n_indeterminate") == 0, "any_row_numeric": F.col("n_numeric") > 0}
    )
