"""Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import carried, column_of, restored

WINDOW = 3
#: A character that is not white space, escaped for a SQL literal.
WORDY = r"[^ \\t-\\r]"


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """One row per window of ``width`` consecutive lines that have a word: two independent 64-bit hashes, key, first line's rank."""
    lines = f"filter(split(text, '\\n', -1), x -> x RLIKE '{WORDY}')"
    args = lambda seed: ", ".join([str(seed), *(f"l[i + {k}]" for k in range(width))])
    return (
        docs.where("text IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("th"), F.expr(lines).alias("l"))
        .where(f"size(l) >= {width}")
        .select("doc_id", "th", F.expr(f"inline(transform(sequence(0, size(l) - {width}), i -> struct(xxhash64({args(1)}) AS h1, xxhash64({args(2)}) AS h2, i AS rank)))"))
    )


def later_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, th (the text's hash) and the ranks of the windows that occurred before, by (doc_id, rank).

    Rows with the same doc_id and text are one document. The first occurrence of each window is found with partial
    aggregation, so a window that a third of all documents share costs one row per task; the join back is an ordinary
    equi-join, of which the adaptive planner splits large partitions.
    """
    windows = _windows(docs, width)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "rank")).alias("f"), F.max(F.struct("doc_id", "th", "rank")).alias("g")).where("f != g").select("h1", "h2", "f")
    return windows.join(first, ["h1", "h2"]).where("NOT struct(doc_id, th, rank) <=> f").groupBy("doc_id", "th").agg(F.collect_set("rank").alias("ranks"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (lines with a word) and ``n_removed``.

    A window is ``width`` consecutive lines that have a word, compared character by character (through 128 bits of
    hashes). All lines of every window that occurred before, in a lower doc_id or further up, are removed; overlapping
    windows merge. Lines without a word never count and stay. Documents with fewer lines stay whole; a null text stays
    null with no lines. A null doc_id comes before all others. Columns of ``docs`` with these names are replaced.
    """
    late = later_windows(docs, width).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("ranks").alias("_ranks"))
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed")]
    out = carried(docs).join(late, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    out = out.withColumn("_lines", F.split("text", "\n", -1))
    # ranks of the lines with a word, then positions. Each array is used twice or more in the next step: the optimizer
    # doesn't inline such a column into a lambda, where it would be made anew for every element.
    out = out.withColumn("_at", F.expr(f"filter(transform(_lines, (x, i) -> IF(x RLIKE '{WORDY}', i, NULL)), i -> i IS NOT NULL)"))
    cover = ", ".join(f"_at[r + {k}]" for k in range(width))
    out = out.withColumn("_gone", F.expr(f"array_distinct(flatten(transform(_ranks, r -> array({cover}))))"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    return out.select(
        *(column_of(c).alias(c) for c in names),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.when(F.size("_gone") < F.size("_lines"), left).otherwise(F.lit(""))).alias("kept_text"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )


def lines_digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def lines_stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the text that is left, and n_chars after it; a document of which no line is left goes. Other columns keep their values, whatever their names."""
    out = dedup_lines(carried(docs)).where("n_removed = 0 OR n_removed < n_lines")
    return restored(out, docs.columns, text=F.col("kept_text"), n_chars=F.coalesce(F.length("kept_text"), F.lit(0)).cast("long"))


#: For windows of three lines; lines are compared as they are.
LINES_SQL = r"""
WITH l AS (SELECT d.doc_id, u.at, u.line, row_number() OVER (PARTITION BY d.doc_id ORDER BY u.at) AS rank
           FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, unnest(range(len(string_split(d.text, chr(10))))) AS at) u
           WHERE regexp_matches(u.line, '[^ \t-\r]')),
w AS (SELECT doc_id, rank, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY rank)),
late AS (SELECT doc_id, rank FROM (SELECT doc_id, rank, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, rank) AS nth FROM w WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.at FROM late JOIN l ON l.doc_id = late.doc_id AND l.rank BETWEEN late.rank AND late.rank + 2),
parts AS (SELECT d.doc_id, u.at, u.line FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, unnest(range(len(string_split(d.text, chr(10))))) AS at) u),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.at) AS t FROM parts p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY p.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM l WHERE l.doc_id = d.doc_id), 0) AS n_lines, coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
