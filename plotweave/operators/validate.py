"""Scoring results against targets: match shares, tiers and verdicts, gates, reconciliation, digests, contracts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import rel_diff, verdict, within_gate
from .segments import along


def match_shares(cand: Column, ref: Column, exact: float, within: float) -> list[Column]:
    """Aggregates over pairs where both are there: n, share equal to ``exact``, share ``within``, median relative difference and ratio. Zero against zero matches."""
    both = cand.isNotNull() & ref.isNotNull()
    rel = F.when(both, rel_diff(cand, ref))
    share = lambda tol: F.avg(F.when(both, (rel <= tol).cast("double")))
    return [F.count_if(both).alias("n"), share(exact).alias("exact"), share(within).alias("within"), F.median(F.when(rel < float("inf"), rel)).alias("median_rel"), F.median(F.when(both & (ref != 0), cand / ref)).alias("median_ratio")]


def series_agreement(df: DataFrame, cand: str, ref: str, exact: float, tight: float, wide: float) -> DataFrame:
    """One row: n, shares at three tolerances, largest finite relative difference, correlation, zeros of the reference and the share of them that agree."""
    c, r = F.col(cand), F.col(ref)
    d = df.where(c.isNotNull() & r.isNotNull())
    rel = rel_diff(c, r)
    share = lambda tol: F.avg((rel <= tol).cast("double"))
    return d.agg(F.count("*").alias("n_common"), share(exact).alias("exact"), share(tight).alias("within_tight"), share(wide).alias("within_wide"), F.max(F.when(rel < float("inf"), rel)).alias("max_rel"), F.corr(cand, ref).alias("pearson"), F.count_if(r == 0).alias("n_ref_zero"), F.avg(F.when(r == 0, (c == 0).cast("double"))).alias("zero_agree"))


def acceptance(df: DataFrame, pass_tight: float, warn_wide: float, informational: bool = False) -> DataFrame:
    """Adds verdict to rows of ``series_agreement``: PASS, PASS WITH WARNING or FAIL; INFORMATIONAL for a declared variant, which never fails."""
    v = F.when(F.col("n_common") == 0, "FAIL").when(F.col("within_tight") >= pass_tight, "PASS").when(F.col("within_wide") >= warn_wide, "PASS WITH WARNING").otherwise("FAIL")
    return df.withColumn("verdict", F.lit("INFORMATIONAL") if informational else v)


def gate(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All expected figures (keys, target) with value, delta, within_tol and scored. A figure that is absent is a miss; one without a target isn't scored."""
    out = expected.join(actual, list(keys), "left")
    return out.withColumns({"delta": F.col("value") - F.col("target"), "within_tol": within_gate(F.col("value"), F.col("target")), "scored": F.col("target").isNotNull()})


def tally(gated: DataFrame, by: Sequence[str]) -> DataFrame:
    return gated.groupBy(*by).agg(F.count_if("scored").alias("n_scored"), F.count_if(F.col("scored") & F.col("within_tol")).alias("n_hit"), F.count_if(F.col("scored") & F.col("value").isNull()).alias("n_absent"))


def reconcile(df: DataFrame, value: str, target: str, rtol: float) -> DataFrame:
    return df.withColumn("verdict", verdict(F.col(value), F.col(target), rtol))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each that the other lacks, as multisets; both zero for equal tables. Both sides are counted by row with partial sums."""
    cols = a.columns
    side = lambda df, s: df.select(*cols, F.lit(s).alias("_s"))
    per = side(a, 1).unionByName(side(b, -1)).groupBy(*cols).agg(F.sum("_s").alias("n"))
    return per.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_b"))


def largest_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row: matched keys, keys on one side alone, and the largest absolute difference of each column."""
    joined = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(1).alias("_a")).join(b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(1).alias("_b")), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.agg(F.count_if(both).alias("n_both"), F.count_if(~both).alias("n_one_side"), *(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_{c}") for c in cols))


def require(df: DataFrame, test: Column, message: str) -> DataFrame:
    """The frame; a row that fails the test raises when it is reached."""
    first = df.columns[0]
    ok = F.when(F.coalesce(test, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[first].dataType))
    return df.withColumn(first, ok)


def declared_counts(counts: DataFrame, declared: dict[str, int]) -> DataFrame:
    """name, n, declared, ok for each declared count."""
    spec = F.explode(F.create_map(*(F.lit(v) for kv in declared.items() for v in kv)))
    want = counts.sparkSession.range(1).select(spec.alias("name", "declared"))
    return want.join(counts, "name", "left").select("name", "n", F.col("declared").cast("long").alias("declared"), F.coalesce(F.col("n") == F.col("declared"), F.lit(False)).alias("ok"))


def digest(df: DataFrame, key: str, content: str, digits: int = 3) -> DataFrame:
    """One row: the number of parts and a digest of digests. Parts are files, whose digests, not contents, meet.

    The first ``digits`` hexadecimal digits of a key's hash name its group. A group's digest is over keys and content
    digests in order of the keys, the last one over groups in order, so a task holds a group, never all parts.
    """
    parts = df.select(F.col(key).cast("string").alias("k"), F.sha2(F.col(content).cast("binary"), 256).alias("d")).withColumn("g", F.substring(F.sha2(F.col("k").cast("binary"), 256), 1, digits))
    text = lambda a, b: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda s: F.concat(s[a], s[b])), ""), 256)
    groups = parts.groupBy("g").agg(F.count("*").alias("n"), text("k", "d").alias("d"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), text("g", "d").alias("digest"))


def worst(df: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(n)


def sample_points(seg: DataFrame, step: float = 5.0, inset: float = 1.0) -> DataFrame:
    """Points along straight segments (id, x1, y1, x2, y2): one ``inset`` from each end and every ``step`` between; enum is their order along the segment."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.floor((length - 2 * inset) / step)
    inner = F.when(n > 1, F.transform(F.sequence(F.lit(1).cast("long"), n - 1), lambda k: F.lit(inset) + k * step)).otherwise(F.array().cast("array<double>"))
    at = F.when(length > 2 * inset, F.concat(F.array(F.lit(inset)), inner, F.array(length - inset))).otherwise(F.array(length / 2))
    out = seg.withColumn("_l", length).select("*", F.posexplode(at).alias("enum", "_d")).withColumn("_t", F.coalesce(F.try_divide(F.col("_d"), F.col("_l")), F.lit(0.0)))
    return out.select("id", "enum", (F.col("x1") + F.col("_t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("_t") * (F.col("y2") - F.col("y1"))).alias("y"))


def thin_points(points: DataFrame) -> DataFrame:
    """The first point, by (id, enum), in each square metre; equal points fall in one square, so one pass does for both."""
    order = Window.partitionBy(F.rint("x"), F.rint("y")).orderBy("id", "enum")
    return points.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


#: Segments that meet a tile of ``thinned_samples``, on the average.
TILE_SEGMENTS = 20_000


def _first_in_squares(step: float, inset: float, tile: int):
    """Rows (id, x1, y1, x2, y2, length, bx, by) sorted by tile and id: the points of ``sample_points`` that lie in the tile and in a square metre that had none."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        now, taken = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2", "length", "bx", "by")}
            length, dx, dy = cols["length"], cols["x2"] - cols["x1"], cols["y2"] - cols["y1"]
            n = np.floor((length - 2 * inset) / step)
            many = np.where(length > 2 * inset, 2 + np.maximum(n - 1, 0), 1).astype(np.int64)
            # the part of the segment that runs in the tile, with a margin of a metre
            low, high = np.zeros(len(length)), length.copy()
            for a, d, b in ((cols["x1"], dx, cols["bx"]), (cols["y1"], dy, cols["by"])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    u, v = ((b * tile - 2 - a) / d * length, ((b + 1) * tile + 2 - a) / d * length)
                moves = np.abs(d) > 1e-9 * length
                low = np.where(moves, np.maximum(low, np.minimum(u, v)), low)
                high = np.where(moves, np.minimum(high, np.maximum(u, v)), high)
            begin = np.clip(np.floor((low - inset) / step) - 1, 0, many - 1).astype(np.int64)
            end = np.clip(np.ceil((high - inset) / step) + 2, 0, many).astype(np.int64)
            end = np.where(high >= length - inset - step, many, end)  # the last point stands closer
            some = np.maximum(end - begin, 0)
            row = np.repeat(np.arange(len(length)), some)
            enum = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some) + begin[row]
            at = np.where(enum == 0, inset, np.where(enum == many[row] - 1, length[row] - inset, inset + enum * step))
            at = np.where(many[row] == 1, length[row] / 2, at)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(length[row] == 0, 0.0, at / length[row])
            x, y = cols["x1"][row] + t * dx[row], cols["y1"][row] + t * dy[row]
            cx, cy = np.rint(x) - cols["bx"][row] * tile, np.rint(y) - cols["by"][row] * tile
            there = np.flatnonzero((cx >= 0) & (cx < tile) & (cy >= 0) & (cy < tile))
            cell = (cx[there] * tile + cy[there]).astype(np.int64)
            bx, by = cols["bx"][row[there]], cols["by"][row[there]]
            starts = np.flatnonzero(np.r_[True, (np.diff(bx) != 0) | (np.diff(by) != 0)]) if len(there) else np.empty(0, np.int64)
            kept = []
            for a, b in zip(starts, np.r_[starts[1:], len(there)]):
                if (bx[a], by[a]) != now:
                    now, taken = (bx[a], by[a]), np.zeros(tile * tile, bool)
                first = a + np.unique(cell[a:b], return_index=True)[1]
                first = np.sort(first[~taken[cell[first]]])
                taken[cell[first]] = True
                kept.append(there[first])
            if kept:
                k = np.concatenate(kept)
                yield pa.record_batch([batch.column("id").take(pa.array(row[k])), pa.array(enum[k].astype(np.int32)), pa.array(x[k]), pa.array(y[k])], ["id", "enum", "x", "y"])

    return run


def thinned_samples(seg: DataFrame, step: float = 5.0, inset: float = 1.0) -> DataFrame:
    """What ``thin_points(sample_points(seg))`` gives, with segments shuffled and not their points.

    Segments go to the tiles that they come near, a tile's arrive in order of their id, and each point is made in the tile
    that holds its square metre: it stays if that is free. A task holds one bit field of a tile, however many segments meet
    there. Segments without coordinates have no points.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    known = seg.select(F.col("id").alias("seg"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).where("x1 + x2 + y1 + y2 IS NOT NULL")
    n, mean, x0, x1, y0, y1 = known.agg(F.count("*"), F.avg(length), F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1")).first()
    area = max((x1 or 0) - (x0 or 0), 1.0) * max((y1 or 0) - (y0 or 0), 1.0)
    tile = int(min(max(math.sqrt(area * TILE_SEGMENTS / max(n, 1)), (mean or 0.0) / 2, 32.0), 2048.0))
    parts = 4 * max(seg.sparkSession.sparkContext.defaultParallelism, int(seg.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    filed = along(known, float(tile), 1.0).select(F.col("r_id").alias("id"), "x1", "y1", "x2", "y2", length.alias("length"), "bx", "by")
    dealt = filed.repartition(parts, "bx", "by").sortWithinPartitions("bx", "by", "id")
    return dealt.mapInArrow(_first_in_squares(float(step), float(inset), tile), f"id {seg.schema['id'].dataType.simpleString()}, enum int, x double, y double")


def jitter(df: DataFrame, x: str, y: str, key: str, radius: float = 0.5) -> DataFrame:
    """Moves rows that share coordinates with another into a disc around them, by hashes of the key, so that a rerun gives the same places."""
    u = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shared = F.count("*").over(Window.partitionBy(x, y)) > 1
    angle, r = u(1) * (2 * 3.141592653589793), F.sqrt(u(2)) * radius
    return df.withColumn("_m", shared).withColumns({x: F.when(F.col("_m"), F.col(x) + r * F.cos(angle)).otherwise(F.col(x)), y: F.when(F.col("_m"), F.col(y) + r * F.sin(angle)).otherwise(F.col(y))}).drop("_m")


def collapse_points(df: DataFrame, x: str, y: str, value: str, order: str) -> DataFrame:
    """One row per coordinate: n, the mean value, and the id that comes first."""
    return df.groupBy(x, y).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min_by(order, order).alias("first"))
