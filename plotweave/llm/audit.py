"""Interactions of filters: how many documents every order of five filters keeps, removes and removes twice."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
#: Runs of white space between words, and the symbols of filter D, as patterns.
WHITE, SYMBOLS = r"[ \t-\r]+", r"[#$%&*|]"


def failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D. Words are maximal runs of all but space and the codes 9 to 13, and are told apart by case."""
    words = F.filter(F.split(text, WHITE, -1), lambda w: w != "")
    kinds = F.size(F.array_distinct(words))
    small = F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * kinds < DISTINCT_PERCENT * F.size(words),
        100 * (F.length(text) - small) > CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def _mask(failed: list[Column]) -> Column:
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask (bit k: fails filter k), good and toxic for every row of ``docs``.

    The only thing that is shuffled of a text is its 256-bit digest. The least doc_id of a text comes from a grouping with
    partial sums, so a text that a third of all rows hold is one row a task; rows meet it in an equi-join of which the
    adaptive planner splits large partitions, and texts without a second doc_id don't take part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = scratch.cut(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(failures(F.col("text"))).alias("mask")), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = scratch.cut(first, "first")  # a written table, so that both sides of the join are plain exchanges
    flags = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return (
        rows.join(first, "digest", "left")
        .select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))
        .join(scratch.cut(flags, "flags"), "doc_id", "left")
        .select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def cells(masked: DataFrame) -> DataFrame:
    """part, and maps of mask to documents (n), good documents and toxic ones: 32 entries at most."""
    per = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    entries = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    of = lambda name: F.map_from_entries(F.transform("cells", lambda c: F.struct(c["mask"], c[name]))).alias(name)
    return per.groupBy("part").agg(entries.alias("cells")).select("part", of("n"), of("good"), of("toxic"))


def _over(counts: str, condition: str) -> str:
    """The sum of a map's entries whose mask m meets the condition."""
    return f"aggregate(map_entries({counts}), 0L, (s, e) -> s + IF({condition.replace('m', 'e.key')}, e.value, 0L))"


def enumerate_orders(cells: DataFrame) -> DataFrame:
    """Every part's steps of every order of the filters, from its cells alone: 600 rows a part, however many documents it has."""
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {at}, 1)) - 1)"
    before = f"aggregate(sequence(0, step - 1), 0, (b, i) -> IF(i = 0, b, b | {bit('i')}))"
    steps = (
        cells.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .selectExpr("*", f"{bit('step')} AS bit", f"{before} AS before")
        .selectExpr("*", "substr(filter_order, step, 1) AS letter")
    )
    removed = "(m & bit) != 0 AND (m & before) = 0"
    counted = steps.selectExpr(
        "part", "filter_order", "step", "letter",
        f"{_over('n', '(m & (bit | before)) = 0')} AS kept",
        f"{_over('n', removed)} AS removed",
        f"{_over('n', '(m & bit) != 0 AND (m & before) != 0')} AS redundant",
        f"{_over('n', 'm = bit')} AS unique_fails",
        f"{_over('good', removed)} AS good_lost",
        f"{_over('toxic', removed)} AS toxic_lost",
    )
    shares = counted.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "letter"]).drop("letter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each source.

    Filters fail a text A: of under 50 words; B: with under 65 distinct words in 100; C: with over 5 capitals A to Z in
    100 code points; D: with one of ``#$%&*|``; E: that a row with a smaller doc_id holds too. Null texts are empty (they
    fail A; an empty text equals another); a null source is the empty part; a null doc_id is neither smaller nor larger
    than any and has no label; of repeated rows none is the smaller; of several labels of a doc_id any 1 counts; very long
    texts are measured in place; an empty table gives an empty one; other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    known = scratch.cut(cells(masks(docs, labels, scratch)), "cells")
    scratch.keep("cells")
    return enumerate_orders(known)


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
              regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, FALSE)] AS failed FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, instr('ABCDE', substr(filter_order, step, 1)) AS own,
             list_transform(range(1, step), lambda i: instr('ABCDE', substr(filter_order, CAST(i AS INT), 1))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT *, failed[own] AS fails, len(list_filter(before, lambda i: failed[i])) > 0 AS gone FROM c, s),
g AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND len(list_filter(failed, lambda b: b)) = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
