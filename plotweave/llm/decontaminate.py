"""Benchmark decontamination by winnowed word fingerprints, extended to exact windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import carried, restored

# The window that counts as an occurrence, and what lies between words.
SPAN = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a fingerprint and fingerprints of a window: GRAM + WINNOW - 1 = SPAN, so every span of SPAN words keeps one.
GRAM, WINNOW = 5, 6
#: The benchmark's tables are broadcast when its pairs of window and item are so many at most; beyond, joins shuffle both sides.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN, -1), "")


def _hash(array: str, at: str, n: int, seed: int = 42) -> str:
    return f"xxhash64({seed}, " + ", ".join(f"{array}[{at} + {k}]" for k in range(n)) + ")"


def _least(at: str) -> str:
    return "least(" + ", ".join(f"g[{at} + {k}]" for k in range(WINNOW)) + ")"


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds g, the hashes of all GRAM-word runs of w."""
    return df.withColumn("g", F.expr(f"CASE WHEN size(w) >= {SPAN} THEN transform(sequence(0, size(w) - {GRAM}), i -> {_hash('w', 'i', GRAM)}) END"))


def _prints(lengths: list[int]) -> str:
    """All fingerprints of a row of _with_grams: winnowed runs, and every run of a length that a short item has."""
    parts = [f"CASE WHEN g IS NULL THEN array() ELSE transform(sequence(0, size(g) - {WINNOW}), i -> {_least('i')}) END"]
    parts += [f"CASE WHEN size(w) < {n} THEN array() ELSE transform(sequence(0, size(w) - {n}), i -> {_hash('w', 'i', n, n)}) END" for n in lengths]
    return "array_distinct(concat(" + ", ".join(parts) + "))"


class Benchmark:
    """The windows of the benchmark's items, with their fingerprints.

    ``windows``: h1, h2, win, fp, each window once; ``owners``: h1, h2, item_id. Items without words have no window.
    """

    def __init__(self, items: DataFrame):
        w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
        cut = w.select("item_id", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {SPAN}, 0)), i -> slice(w, i + 1, {SPAN})))").alias("win"))
        self.lengths = sorted(r[0] for r in w.where(f"size(w) < {SPAN}").select(F.size("w")).distinct().collect())  # nine at most
        keyed = cut.withColumns({"h1": F.xxhash64(F.lit(1), "win"), "h2": F.xxhash64(F.lit(2), "win")})
        self.owners = keyed.select("h1", "h2", "item_id").distinct()
        one = keyed.groupBy("h1", "h2").agg(F.first("win").alias("win"))
        long = _with_grams(one.withColumnRenamed("win", "w")).withColumn("fp", F.expr(f"CASE WHEN g IS NOT NULL THEN {_least('0')} " + " ".join(f"WHEN size(w) = {n} THEN {_hash('w', '0', n, n)}" for n in self.lengths) + " END"))
        self.windows = long.select("h1", "h2", F.col("w").alias("win"), "fp")
        self.small = self.owners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # no more windows than owners

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, Benchmark]:
    """doc_id, th (the text's hash), start, n, h1, h2: every place where a benchmark window occurs in a document.

    First the fingerprints of all documents meet those of the benchmark; a document's distinct fingerprints leave the
    scan, not its text. Documents with a common fingerprint are read again and extended: each of their windows whose
    fingerprint is shared is compared word by word with the benchmark's windows. As every window of SPAN words keeps the
    least of its WINNOW hashes, equal windows keep equal fingerprints and none is missed.
    """
    bench = Benchmark(items)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).where("size(w) > 0")
    marks = _with_grams(base).select("doc_id", "th", F.explode(F.expr(_prints(bench.lengths))).alias("fp"))
    shared = marks.join(bench.side(bench.windows.select("fp").distinct()), "fp").groupBy("doc_id", "th").agg(F.collect_set("fp").alias("fps"))
    s = shared.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "fps")
    again = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(s, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "fps", words(F.col("text")).alias("w"))

    def starts(n: int, test: str) -> str:
        there = f"filter(sequence(0, size(w) - {n}), i -> array_contains(fps, {test}))"
        return f"CASE WHEN size(w) < {n} THEN array() ELSE transform({there}, i -> struct(i AS start, {n} AS n, slice(w, i + 1, {n}) AS win)) END"

    parts = [starts(SPAN, _least("i")), *(starts(n, _hash("w", "i", n, n)) for n in bench.lengths)]
    found = _with_grams(again).select("doc_id", "th", F.expr(f"inline(concat({', '.join(parts)}))"))
    found = found.withColumns({"h1": F.xxhash64(F.lit(1), "win"), "h2": F.xxhash64(F.lit(2), "win")})
    return found.join(bench.side(bench.windows.select("h1", "h2", F.col("win").alias("_win"))), ["h1", "h2"]).where("win = _win").select("doc_id", "th", "start", "n", "h1", "h2"), bench


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) and hits (start and n of the windows found) for every row.

    Null texts have no words; repeated rows each get the same result; an empty benchmark hits nothing; a null item_id is
    no item, though its windows hit; other columns are dropped.
    """
    hits, bench = occurrences(docs, items)
    places = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("hits"))
    owned = hits.select("doc_id", "th", "h1", "h2").distinct().join(bench.side(bench.owners), ["h1", "h2"]).groupBy("doc_id", "th").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    both = places.join(owned, places["doc_id"].eqNullSafe(owned["doc_id"]) & (places["th"] == owned["th"]), "left").select(places["doc_id"].alias("_id"), places["th"].alias("_th"), "hits", "items")
    covered = "aggregate(array_sort(hits), struct(0 AS n, 0 AS e), (a, x) -> struct(a.n + greatest(0, x.start + x.n - greatest(a.e, x.start)) AS n, greatest(a.e, x.start + x.n) AS e), a -> a.n)"
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return all_docs.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select(
        "doc_id", "n_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"), "hits"
    )


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontamination_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no window of the benchmark, with their own columns, whatever their names. Null texts stay; repeated rows stay or go together."""
    hit = occurrences(docs, items)[0].select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows = carried(docs)
    clean = rows.join(hit, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(rows["text"]) == F.col("_th")), "left_anti")
    return restored(clean, docs.columns)


DECONTAMINATION_SQL = r"""
WITH low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT r.doc_id, r.i, r.n, w.item_id FROM runs r JOIN wins w ON w.n = r.n AND w.win = r.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN hit_words h ON h.doc_id = l.doc_id LEFT JOIN hit_items t ON t.doc_id = l.doc_id
"""
