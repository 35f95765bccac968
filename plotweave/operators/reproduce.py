"""Whether one run's tables give another's: cells, points, counts, areas, subgraphs, checksums, claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import rel_diff


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols)))
    return df.select(*keys, pairs.alias("_s")).select(*keys, "_s.*")


STATISTICS = {"mean": F.avg, "sum": F.sum, "median": F.median}


def cell_reproduction(pairs: DataFrame, measures: Sequence[str], frozen: DataFrame, exact: float, within: float) -> DataFrame:
    """frozen_column, aggregation, segment_column, n, exact, within: every measure of the cells' segments against every frozen column with that statistic's suffix.

    All measures are scored against all columns, so a column that another measure reproduces shows. A cell without
    segments has no value and isn't scored.
    """
    out = None
    for stat, f in STATISTICS.items():
        cols = [c for c in frozen.columns if c.endswith(f"_{stat}")]
        if not cols:
            continue
        got = _long(pairs.groupBy("cell").agg(*(f(m).alias(m) for m in measures)), ["cell"], measures, "segment_column", "c")
        both = got.join(_long(frozen, ["cell"], cols, "frozen_column", "r"), "cell").where("c IS NOT NULL AND r IS NOT NULL")
        rel = rel_diff(F.col("c"), F.col("r"))
        share = lambda tol: F.avg((rel <= tol).cast("double"))
        scored = both.groupBy("frozen_column", "segment_column").agg(F.count("*").alias("n"), share(exact).alias("exact"), share(within).alias("within"))
        scored = scored.select("frozen_column", F.lit(stat).alias("aggregation"), "segment_column", "n", "exact", "within")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no frozen column ends with the name of a statistic")
    return out


def point_reproduction(points: DataFrame, nearest: DataFrame, seg: DataFrame, measures: Sequence[str], cols: Sequence[str], exact: float, within: float) -> DataFrame:
    """measure, segment_column, n, exact, within, within_best_of_ties, fails, fails_at_tie, fails_zero.

    A point's measure is held against the columns of its nearest segment; with ties, against the first one, and for the
    best of ties against all. Two zeros agree; a zero against another value doesn't.
    """
    a, b = F.col("a"), F.col("b")
    rel, zero = F.try_divide(F.abs(a - b), F.abs(b)), (a == 0) & (b == 0)
    ok = lambda tol: F.coalesce((rel < tol) | zero, F.lit(False))
    met = nearest.join(_long(points, ["id"], measures, "measure", "a").withColumnRenamed("id", "q_id"), "q_id").join(_long(seg, ["seg"], cols, "segment_column", "b").withColumnRenamed("seg", "r_id"), "r_id")
    first = F.col("nth") == 1
    each = met.groupBy("measure", "segment_column", "q_id").agg(
        F.bool_or(first & ok(exact)).alias("e"), F.bool_or(first & ok(within)).alias("w"), F.bool_or(ok(within)).alias("best"), F.bool_or("tied").alias("tied"), F.bool_or(a == 0).alias("zero")
    )
    share = lambda c: F.avg(F.col(c).cast("double"))
    fails = ~F.col("w")
    return each.groupBy("measure", "segment_column").agg(
        F.count("*").alias("n"), share("e").alias("exact"), share("w").alias("within"), share("best").alias("within_best_of_ties"), F.count_if(fails).alias("fails"), F.count_if(fails & F.col("tied")).alias("fails_at_tie"), F.count_if(fails & F.col("zero")).alias("fails_zero")
    )


def cell_counts(pairs: DataFrame, cells: DataFrame, target: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Per rule: pairs, target_pairs, segments, cells_exact, cells_total, cells_exact_share, most (largest difference).

    ``pairs`` has rule, seg and cell, ``target`` cell and n. A cell without a target agrees when no segment lies in it, and
    a rule of ``rules`` without pairs has zeros.
    """
    each = F.explode(F.array(*map(F.lit, rules)))
    got = pairs.groupBy("rule", "cell").agg(F.count("*").alias("got"))
    grid = cells.select("cell").join(target.select("cell", "n"), "cell", "left").withColumn("rule", each).join(got, ["rule", "cell"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    agree = F.coalesce(F.col("got") == F.col("n"), F.col("got") == 0)
    out = grid.groupBy("rule").agg(F.sum("got").alias("pairs"), F.sum("n").alias("target_pairs"), F.count_if(agree).alias("cells_exact"), F.count("*").alias("cells_total"), F.avg(agree.cast("double")).alias("cells_exact_share"), F.max(F.abs(F.col("got") - F.col("n"))).alias("most"))
    counted = pairs.groupBy("rule").agg(F.count_distinct("seg").alias("segments"))
    return out.join(counted, "rule", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


def area_score(df: DataFrame, rebuilt: str, reference: str) -> DataFrame:
    """One row on how rebuilt areas follow the reference's: agreement of the sets of zones (area above 0), bands, quantiles, totals."""
    a, b = F.col(rebuilt), F.col(reference)
    za, zb = a > 0, b > 0
    rel = F.when(za & zb, F.abs(a - b) / b)
    above = rel >= 1e-2
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(za).alias("n_rebuilt"), F.count_if(zb).alias("n_reference"), F.avg((za == zb).cast("double")).alias("zone_set_agreement"), F.count_if(za & ~zb).alias("n_only_rebuilt"), F.count_if(~za & zb).alias("n_only_reference"),
        F.avg((rel < 1e-3).cast("double")).alias("within_01pct"), F.avg((rel < 1e-2).cast("double")).alias("within_1pct"), F.percentile(rel, 0.9).alias("p90_rel"), F.percentile(rel, 0.99).alias("p99_rel"), F.max(rel).alias("max_rel"), F.count_if(above).alias("n_above"),
        ((F.sum(a) - F.sum(b)) / F.sum(b)).alias("total_rel"), (F.coalesce(F.sum(F.when(above, b)), F.lit(0.0)) / F.sum(b)).alias("area_share_above"),
    )


def determinacy(df: DataFrame, group: str, test: Column) -> DataFrame:
    """group, n, n_determinate, n_dropped, pct_determinate."""
    yes = F.count_if(F.coalesce(test, F.lit(False)))
    return df.groupBy(group).agg(F.count("*").alias("n"), yes.alias("n_determinate"), (F.count("*") - yes).alias("n_dropped"), (yes * 100.0 / F.count("*")).alias("pct_determinate"))


def strict_subgraph(variant: DataFrame, reference: DataFrame, keys: Sequence[str], length: str, geometry: Sequence[str]) -> DataFrame:
    """One row: segments, missing (not in the reference), max_length_diff, same_geometry, ok. Geometry is equal bit by bit."""
    joined = variant.select(*keys, length, *geometry).join(reference.select(*keys, F.col(length).alias("_l"), *(F.col(g).alias(f"_{g}") for g in geometry)), list(keys), "left")
    same = F.lit(True)
    for g in geometry:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    missing = F.col("_l").isNull()
    out = joined.agg(F.count("*").alias("segments"), F.count_if(missing).alias("missing"), F.coalesce(F.max(F.abs(F.col(length) - F.col("_l"))), F.lit(0.0)).alias("max_length_diff"), F.count_if(same & ~missing).alias("same_geometry"))
    return out.withColumn("ok", F.expr("missing = 0 AND max_length_diff = 0 AND same_geometry = segments"))


def claim_flags(df: DataFrame, by: str, measure: str, value: str, first: str, access: Sequence[str], inter: Sequence[str]) -> DataFrame:
    """by, is_first (``first`` has the largest value) and access_beats (the least of ``access`` exceeds the largest of ``inter``)."""
    of = lambda names: F.when(F.col(measure).isin(*names), F.col(value))
    return df.groupBy(by).agg((F.max_by(measure, value) == first).alias("is_first"), (F.min(of(access)) > F.max(of(inter))).alias("access_beats"))


def verify_sums(sums: DataFrame, files: DataFrame) -> DataFrame:
    """path and fault of listed files (path, digest) that are missing from ``files`` (path, content) or have another SHA-256."""
    held = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.lower("digest") != F.col("found"), "checksum differs")
    return sums.join(held, "path", "left").select("path", fault.alias("fault")).where("fault IS NOT NULL")


def require_no_drift(config: Mapping, copies: Mapping[str, Mapping], known: Sequence[str] = ()) -> None:
    """Raise where a copy of settings (by its name) has another value than ``config`` for a key of both, or a name in ``known`` has no copy."""
    for name, own in copies.items():
        for k in own.keys() & config.keys():
            if own[k] != config[k]:
                raise ValueError(f"config drift: {k} = {config[k]!r} but {name}.{k} = {own[k]!r}")
    if absent := [n for n in known if n not in copies]:
        raise KeyError(f"unknown variants: {absent}")
