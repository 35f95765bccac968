"""Rankings, order strings, the choice rule, agreement and changes of verdicts, long and wide results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def rank_by(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Adds rank, 1 for the largest, ties at the least rank."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(value))))


def order_string(df: DataFrame, groups: Sequence[str], label: str, value: str, mark: str = " > ") -> DataFrame:
    """groups and order: labels from the largest value down, ties by label. A group is a handful of measures."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))))
    return df.groupBy(*groups).agg(F.array_join(F.transform(items, lambda s: s["l"]), mark).alias("order"))


def choice_rule(sweep: DataFrame, bound: float = 0.9, eps: float = 1e-6, lag_most: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """level, k and the rule's verdicts from rows (level, k, measure, beta, p, rho, lag).

    interior: every |rho| is below the bound and every lag parameter below its limit. stable: against the next k no
    significance changes, and no sign of a measure that is significant at either k; stable_all counts every sign. Both are
    null at the largest k. interior_above holds when k and all larger are interior; holds_from_k when every larger k with
    a verdict, and k, satisfies the rule.
    """
    per_measure, up = Window.partitionBy("level", "measure").orderBy("k"), Window.partitionBy("level").orderBy("k")
    sig = F.col("p") < alpha
    d = sweep.withColumns({"sig": sig, "nb": F.lead("beta").over(per_measure), "np": F.lead("p").over(per_measure)}).withColumns({"same_sign": F.signum("beta") == F.signum("nb"), "same_sig": F.col("sig") == (F.col("np") < alpha), "either": F.col("sig") | (F.col("np") < alpha)})
    rule = d.groupBy("level", "k").agg(
        F.bool_and((F.abs("rho") < bound - eps) & (F.col("lag") < lag_most)).alias("interior"),
        F.count_if(F.abs(F.abs("rho") - bound) < eps).alias("n_at_bound"),
        F.count("same_sign").alias("n_next"),
        F.count_if(~F.col("same_sign") & F.col("either")).alias("n_flips"),
        F.bool_and("same_sig").alias("sig_ok"),
        F.bool_and("same_sign").alias("sign_ok"),
    )
    rule = rule.withColumns({"stable": F.when(F.col("n_next") > 0, F.col("sig_ok") & (F.col("n_flips") == 0)), "stable_all": F.when(F.col("n_next") > 0, F.col("sig_ok") & F.col("sign_ok"))})
    rule = rule.withColumns({"satisfied": F.col("interior") & F.col("stable"), "next_k": F.lead("k").over(up)})
    rule = rule.withColumn("satisfied", F.when(F.col("stable").isNotNull(), F.col("satisfied")))
    above = up.rowsBetween(0, Window.unboundedFollowing)
    return rule.select("level", "k", "next_k", "interior", "n_at_bound", "n_flips", "stable", "stable_all", "satisfied", F.bool_and("interior").over(above).alias("interior_above"), F.coalesce(F.bool_and("satisfied").over(above), F.lit(False)).alias("holds_from_k"))


def rank_agreement(df: DataFrame, base: str, others: Sequence[str], label: str) -> DataFrame:
    """variant, spearman of its average ranks with the base's, same_top."""
    from .stats import ranks

    both = df.join(ranks(df, [base, *others], label), label)
    row = [F.struct(F.lit(o).alias("variant"), F.corr(f"r_{base}", f"r_{o}").alias("spearman"), (F.max_by(label, base) == F.max_by(label, o)).alias("same_top")) for o in others]
    return both.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def verdict_changes(df: DataFrame, keys: Sequence[str], variant: str, baseline: str, alpha: float = 0.05) -> DataFrame:
    """Each variant's row beside its baseline: sign_changed, sig_changed, verdict_changed, and verdict_changed_on_significant (significant in either)."""
    base = df.where(F.col(variant) == baseline).select(*keys, F.col("beta").alias("b0"), F.col("p").alias("p0"))
    sig, sig0 = F.col("p") < alpha, F.col("p0") < alpha
    sign = F.signum("beta") != F.signum("b0")
    return df.where(F.col(variant) != baseline).join(base, list(keys)).select(*keys, variant, sign.alias("sign_changed"), (sig != sig0).alias("sig_changed"), (sign | (sig != sig0)).alias("verdict_changed"), ((sign | (sig != sig0)) & (sig | sig0)).alias("verdict_changed_on_significant"))


def wide(df: DataFrame, keys: Sequence[str], label: str, levels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with <value>_<level> columns; levels are given, so no pass looks for them."""
    out = df.groupBy(*keys).pivot(label, list(levels)).agg(*(F.first(v).alias(v) for v in values))
    return out.withColumnsRenamed({(f"{lv}_{v}" if len(values) > 1 else lv): f"{v}_{lv}" for lv in levels for v in values})


def long(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(values), "statistic", "value")


def complete(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All expected rows; those that are absent have null values."""
    return expected.join(actual, list(keys), "left")


def in_order(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Rows sorted by a stated order of values; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(col))
    return df.orderBy(F.when(at > 0, at).otherwise(len(levels) + 1), col)
