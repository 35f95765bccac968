"""Record linkage: match rates, failures, wildcard and fuzzy matches, guarded and cascading joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import wildcard_pattern
from .lineage import settled


def lookup(df: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Left equi-join; what isn't found is null. Whether the table is broadcast is left to the planner, which knows its size."""
    return df.join(table, on, "left")


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of ``left``, and how many of both are found in ``right``. One shuffle on the key."""
    keys = left.groupBy(key).agg(F.count("*").alias("n"))
    found = right.select(key).distinct().withColumn("hit", F.lit(True))
    return keys.join(found, key, "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("rows_matched"), F.count("*").alias("keys"), F.count("hit").alias("keys_matched"))


def failures(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def wildcard_hits(queries: DataFrame, vocabulary: DataFrame, query: str, word: str) -> DataFrame:
    """query, n_hits, resolved: words that match with ``?`` for one character; resolved only when exactly one does.

    Words of another length can't match, so the lengths are an equi-join and the pattern is a condition on it.
    """
    q = queries.select(F.col(query).alias("q")).distinct().withColumns({"pattern": wildcard_pattern(F.col("q")), "size": F.length("q")})
    v = vocabulary.select(F.col(word).alias("w")).distinct().withColumn("_size", F.length("w"))
    hits = q.join(v, (F.col("size") == F.col("_size")) & F.expr("w RLIKE pattern"), "left").groupBy("q").agg(F.count("w").alias("n_hits"), F.min("w").alias("w"))
    return hits.select(F.col("q").alias(query), "n_hits", F.when(F.col("n_hits") == 1, F.col("w")).alias("resolved"))


def resolve(queries: DataFrame, vocabulary: DataFrame, query: str, word: str) -> DataFrame:
    """query, resolved, flags: the word itself if it is one, else a unique wildcard match, else null, with flags that say which."""
    exact = vocabulary.select(F.col(word).alias(query), F.lit(True).alias("exact")).distinct()
    hits = wildcard_hits(queries, vocabulary, query, word).join(exact, query, "left")
    return hits.select(query, F.when(F.col("exact"), F.col(query)).otherwise(F.col("resolved")).alias("resolved"), F.concat_ws(";", F.when(F.col("exact"), "exact"), F.when(F.col("exact").isNull() & (F.col("n_hits") == 1), "wildcard"), F.when(F.col("exact").isNull() & (F.col("n_hits") > 1), "ambiguous"), F.when(F.col("n_hits") == 0, "unresolved")).alias("flags"))


def fuzzy_nearest(queries: DataFrame, vocabulary: DataFrame, query: str, word: str) -> DataFrame:
    """query, nearest, distance by Levenshtein; of equal distances the first word in order. A diagnostic over distinct strings; nulls are left out.

    The distance is at least the difference of lengths, so words are met by length: first those of the query's own, then
    those that differ by one, and so on. A query with a word no farther than the differences seen is done.
    """
    q = settled(queries.select(query).where(F.col(query).isNotNull()).distinct().withColumn("_n", F.length(query)))
    v = settled(vocabulary.select(F.col(word).alias("w")).where("w IS NOT NULL").distinct().withColumn("_m", F.length("w")))
    sizes = q.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi")).crossJoin(v.agg(F.min("_m").alias("least"), F.max("_m").alias("most"))).first()
    done, best, missing = [], "struct<distance:int,nearest:string>", F.col("_best.distance").isNull()
    rest = q.withColumn("_best", F.lit(None).cast(best))
    farthest = -1 if sizes["lo"] is None or sizes["least"] is None else max(sizes["hi"] - sizes["least"], sizes["most"] - sizes["lo"], 0)
    for gap in range(farthest + 1):
        lengths = F.array_distinct(F.array(F.col("_n") - gap, F.col("_n") + gap))
        met = rest.select(query, F.explode(lengths).alias("_m")).join(v, "_m").groupBy(query).agg(F.min(F.struct(F.levenshtein(query, "w").alias("distance"), F.col("w").alias("nearest"))).alias("_met"))
        seen = settled(rest.join(met, query, "left").select(query, "_n", F.least("_best", "_met").alias("_best")))
        done.append(seen.where(F.col("_best.distance") <= gap))
        rest = seen.where(missing | (F.col("_best.distance") > gap))
        if not rest.take(1):
            break
    out = rest
    for part in done:
        out = out.unionByName(part)
    return out.select(query, "_best.nearest", F.col("_best.distance").cast("long").alias("distance"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses duplicate keys: a key with two rows on a side raises when it is reached."""

    def guarded(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit(f"{side} key is not unique: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key)))

    return guarded(left, "left").join(guarded(right, "right"), key)


def unambiguous(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def unambiguous_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join after keys that are ambiguous on either side are dropped from both."""
    return unambiguous(left, key).join(unambiguous(right, key), key)


def end_key(x1: str, y1: str, x2: str, y2: str, places: int = 3) -> F.Column:
    """A key of a segment that doesn't depend on its direction: ordered ends and length, rounded."""
    a, b = (F.struct(F.round(x, places).alias("x"), F.round(y, places).alias("y")) for x, y in ((x1, y1), (x2, y2)))
    lo, hi = F.least(a, b), F.greatest(a, b)
    length = F.round(F.hypot(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)), places)
    return F.concat_ws("|", *(p[c].cast("string") for p in (lo, hi) for c in ("x", "y")), length.cast("string"))


def cascade(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, F.Column]]) -> tuple[str, DataFrame]:
    """The first key by which any unambiguous pair is found, and the pairs: key, left row, right row. A later key is only tried when those before find nothing."""
    for name, key in keys:
        pairs = unambiguous_join(left.select(key.alias("k"), F.struct(*left.columns).alias("left")), right.select(key.alias("k"), F.struct(*right.columns).alias("right")), "k")
        if pairs.take(1):
            return name, pairs
    raise ValueError("no key matches")


def realigned(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows in order of a key that must be 0 to n - 1, each once; raises for any other set of keys."""
    seen = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most")).first()
    if seen["n"] != n:
        raise ValueError(f"rows changed: {n} in, {seen['n']} out")
    if n and (seen["keys"], seen["least"], seen["most"]) != (n, 0, n - 1):
        raise ValueError(f"{key} isn't 0 to {n - 1}, each once")
    return df.orderBy(key)


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, in a alone and in b alone."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return both.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_only_a"), F.count_if(F.col("in_a").isNull()).alias("n_only_b"))
