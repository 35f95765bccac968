"""Data profiles: counts, crosstabs, distributions, missing values, duplicates, agreement of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import MISSING


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return value_counts(df, col).orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(k)


def crosstab(frames: dict[str, DataFrame], col: str) -> DataFrame:
    """Counts of each value of ``col`` by source, zero where a source has none. Sources are a fixed list, so the pivot needs no pass to find them."""
    long = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("source"), F.col(col).alias("value"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy("value").pivot("source", list(frames)).count().na.fill(0)


def distribution(df: DataFrame, by: str, col: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.median(col).alias("median"), F.percentile(col, 0.25).alias("p25"), F.percentile(col, 0.75).alias("p75"), F.min(col).alias("least"), F.max(col).alias("most"))


def missingness(df: DataFrame, columns: Sequence[str], codes: Sequence[str] = MISSING) -> DataFrame:
    """Per column: rows, blanks, missing codes, zeros, and rows that are any of these or null. One pass for all columns."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    kinds = lambda c: (text(c) == "", text(c).isin(*[x for x in codes if x]), text(c).try_cast("double") == 0)

    def row(c: str) -> Column:
        blank, code, zero = (F.coalesce(k, F.lit(False)) for k in kinds(c))
        return F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(blank).alias("n_blank"), F.count_if(code).alias("n_code"), F.count_if(zero).alias("n_zero"), F.count_if(blank | code | zero | F.col(c).isNull()).alias("n_any"))

    return df.agg(F.array(*(row(c) for c in columns)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct key combinations, rows beyond the first of each."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), (F.sum("n") - F.count("*")).alias("repeats"))


def unit_counts(units: DataFrame, conventions: dict[str, Column], key: str = "addr_key") -> DataFrame:
    """Per convention: rows, keys that keep one, and mean, median and largest count of those; one shuffle on the key for all."""
    per = units.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in conventions.items()))

    def row(n: str) -> Column:
        some = F.when(F.col(n) > 0, F.col(n))
        return F.struct(F.lit(n).alias("convention"), F.sum(n).alias("rows"), F.count(some).alias("keys"), F.avg(some).alias("mean"), F.median(some).alias("median"), F.max(n).alias("most"), F.count_if(F.col(n) == 0).alias("dropped"))

    return per.agg(F.array(*(row(n) for n in conventions)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def source_agreement(a: DataFrame, b: DataFrame, key: str, value: str, rtol: float) -> DataFrame:
    """One row: keys with a value on both sides, those within ``rtol``, and conflicts."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).where("a IS NOT NULL AND b IS NOT NULL")
    near = F.abs(F.col("a") - F.col("b")) <= F.lit(rtol) * F.abs("b")
    return both.agg(F.count("*").alias("n"), F.count_if(near).alias("n_agree"), F.count_if(~near).alias("n_conflict"))
