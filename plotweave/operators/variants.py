"""Variants of samples, rules and extents, and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import truthy


def sample_variants(df: DataFrame, variants: dict[str, Column], value: str) -> DataFrame:
    """variant, n, mean: each variant is a condition on records, and all are scored in one pass."""
    row = [F.struct(F.lit(n).alias("variant"), F.count_if(c).alias("n"), F.avg(F.when(c, F.col(value))).alias("mean")) for n, c in variants.items()]
    return df.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def group_threshold(df: DataFrame, group: str, least: int) -> DataFrame:
    """All groups with n and estimated: groups below the threshold stay listed."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("estimated", F.col("n") >= least)


def zone_eligible(kind: str, speed: str, bridge: str, tunnel: str, drive: str, kinds: Sequence[str], most_speed: float) -> Column:
    """Drivable segments of the given classes below a speed that are neither bridge nor tunnel; flags are read as text."""
    return F.coalesce(F.col(kind).isin(*kinds) & (F.col(speed) <= most_speed), F.lit(False)) & truthy(F.col(drive)) & ~truthy(F.col(bridge)) & ~truthy(F.col(tunnel))


def width_of(kind: Column, widths: dict[str, float], default: float = 5.0) -> Column:
    table = F.create_map(*(F.lit(v) for kv in widths.items() for v in kv))
    return F.coalesce(F.element_at(table, kind), F.lit(default))


def extent_check(seg: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """One row: segments (x1, y1, x2, y2) within the box, those whose box meets it, and those whose midpoint lies in it. In a convex extent a segment lies within when both ends do."""
    inside = lambda x, y: x.between(x0, x1) & y.between(y0, y1)
    a, b = inside(F.col("x1"), F.col("y1")), inside(F.col("x2"), F.col("y2"))
    meets = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y1)
    mid = inside((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return seg.agg(F.count("*").alias("n"), F.count_if(a & b).alias("n_within"), F.count_if(meets).alias("n_box"), F.count_if(mid).alias("n_midpoint"))


def polygon_area(points: Column) -> Column:
    """Area of a ring given as an array of (x, y), by the shoelace sum; the ring may be open or closed."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: points[i]["x"] * points[F.pmod(i + 1, n)]["y"] - points[F.pmod(i + 1, n)]["x"] * points[i]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def constant_rate(df: DataFrame, a: str, b: str, range_most: float = 1e-9) -> DataFrame:
    """One row: the ratio a / b (median), its relative range, and whether it is constant."""
    r = F.col(a) / F.col(b)
    return df.where(f"{b} <> 0").agg(F.median(r).alias("rate"), ((F.max(r) - F.min(r)) / F.median(r)).alias("spread")).withColumn("constant", F.col("spread") <= range_most)


def positivity_breakdown(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, n_null, n_zero, n_negative, n_only (rows that fail by this column alone)."""
    bad = {c: ~F.coalesce(F.col(c) > 0, F.lit(False)) for c in cols}
    total = sum((b.cast("int") for b in bad.values()), F.lit(0))
    row = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if(F.col(c) < 0).alias("n_negative"), F.count_if(b & (total == 1)).alias("n_only")) for c, b in bad.items()]
    return df.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def sweep_scores(df: DataFrame, group: str, candidates: dict[str, Column], target: Column, rtol: float) -> DataFrame:
    """candidate, n, n_match: grouped statistics of every hypothesis against a target per group, the best first. All statistics come out of one aggregation."""
    per = df.groupBy(group).agg(*(c.alias(n) for n, c in candidates.items()), target.alias("_t"))
    long = per.select(F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(n).cast("double").alias("v"), F.col("_t").cast("double").alias("t")) for n in candidates))).alias("s")).select("s.*").where("v IS NOT NULL AND t IS NOT NULL")
    return long.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("v") - F.col("t")) <= F.lit(rtol) * F.abs("t")).alias("n_match"))


def folds(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Adds fold, by a hash of the key: the same in any order and partitioning."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int"))


def cell_text(v: Column) -> Column:
    """Ten and more with one decimal, smaller figures with three."""
    return F.when(F.abs(v) >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.3f", v))


def checked_variants(settings: dict, variants: dict[str, dict], headline: str, alternates: Sequence[str]) -> dict[str, dict]:
    """The variants, after a check that the headline repeats the settings of the same names and that every alternate is there."""
    for name, value in variants[headline].items():
        if name in settings and settings[name] != value:
            raise ValueError(f"settings drift apart: {name} is {settings[name]!r}, but {value!r} in {headline}")
    if unknown := [a for a in alternates if a not in variants]:
        raise KeyError(f"unknown variants: {', '.join(unknown)}")
    return dict(variants)
