"""Ordered exclusion: the order of the steps is part of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import positive
from .lineage import settled
from .stats import quantiles

STEPS = ("positivity", "iqr_outliers")


def fence(df: DataFrame, col: str, multiplier: float = 1.5) -> DataFrame:
    """One row: lo and hi of the inclusive fence around the quartiles (linear interpolation) of the rows that are there; nulls where there are none."""
    q = quantiles(df, [col], [0.25, 0.75]).agg(F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("share") == 0.75, F.col("value"))).alias("q3"))
    width = F.lit(multiplier) * (F.col("q3") - F.col("q1"))
    return q.select((F.col("q1") - width).alias("lo"), (F.col("q3") + width).alias("hi"))


def within_fence(df: DataFrame, col: str, multiplier: float = 1.5) -> DataFrame:
    """Rows between the fence's ends; the one-row fence is broadcast."""
    return df.crossJoin(F.broadcast(fence(df, col, multiplier))).where(F.col(col).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def exclude(df: DataFrame, order: Sequence[str], columns: Sequence[str], fenced: str, multiplier: float = 1.5) -> list[tuple[str, DataFrame]]:
    """(step, rows after it), from 'loaded' on. The fence is that of the rows which reach its step.

    Each step and each pass of a fence reads the rows from a checkpoint: what they come from is worked out once.
    """
    df = settled(df)
    out = [("loaded", df)]
    for step in order:
        if step not in STEPS:
            raise ValueError(f"unknown exclusion step: {step}")
        df = df.where(positive(columns)) if step == "positivity" else within_fence(df, fenced, multiplier)
        out.append((step, df))
    return out


def count_log(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """position, step, n and delta against the step before: one count each, side by side in one query."""
    parts = None
    for k, (name, df) in enumerate(steps):
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("position"), F.lit(name).alias("step"), "n")
        parts = one if parts is None else parts.unionAll(one)
    order = Window.orderBy("position")  # as many rows as steps
    return parts.withColumn("delta", F.col("n") - F.lag("n").over(order))
