"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Parts of a shard that are numbered each for itself: their counts (shards x PARTS rows at most) give each its first slot.
PARTS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the lowest exponential draw -ln(u) / weight for the key; u is a hash of key and shard in (0, 1).

    A shard's draw depends on the key, its number and its weight alone, so a further shard takes only keys whose draw in
    it is the lowest, and takes keys from all others in proportion. A null key is a key like any other. Of equal draws the
    lowest shard wins.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))

    draws = [draw(i, w) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_records(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown: float | None = 1.0) -> DataFrame:
    """Key, size, text_crc32, shard, slot and grown_shard for every row; ``grown`` is the weight of one more shard.

    Slots are gapless from 0 in a shard. Numbering a whole shard would put it into one task, so each shard is numbered in
    PARTS parts by a hash of key and text, and the counts of the parts before give each part its first slot: they are a
    table of shards x PARTS rows at any size, which is broadcast. Only key, size and checksum are shuffled, never a text.
    Null texts are empty; repeated rows get slots of their own, in an order among equal rows that doesn't matter; other
    columns are dropped.
    """
    base = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    more = [*weights, grown] if grown is not None else None
    rows = base.select(
        key,
        (F.octet_length("_text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), more) if more else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("part", F.pmod(F.xxhash64(F.lit(7), key, "text_crc32", "size"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy(F.asc_nulls_first(key), "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(firsts), ["shard", "part"])
        .select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
    )


def sharding_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the law is ``key``."""
    return shard_records(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
