"""Hard negatives: rows of another label whose score lies in a window of the positive's, the best k found by radix selection."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import Scratch

#: Buckets of a digit, and anchors of a block: what a task holds is a block's windows times DIGIT counts.
DIGIT_BITS = 8
DIGIT = 1 << DIGIT_BITS
BLOCK = 1024
POSITIVES, NEGATIVES = 5, 10
#: Rows whose scores are made at once.
ROWS = 4096


@dataclasses.dataclass
class Windows:
    """Of a block: windows of scores from ``low`` to ``high``, each of one anchor (its place in the block) and of the anchor's own label or of all others."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool


@dataclasses.dataclass
class Anchors:
    vec_id: np.ndarray
    label: np.ndarray
    matrix: np.ndarray


def quantised(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label and q (floor(256 x) of each component) of the rows that take part, one for each vec_id.

    A row without vec_id, label or vector, or with a null or non-finite component, takes no part. Where vec_id is divisible
    by 7, label becomes (label + 1) % 10. Of rows with one vec_id that with the least label, then the least components,
    stands for all.
    """
    x = F.col("x")
    found = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    found = found.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = found.select("vec_id", moved.alias("label"), F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("q"))
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; what a shorter vector lacks counts as 0. Doubles where every sum of products is exact in them."""
    offsets, flat = q.offsets.to_numpy(), q.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - offsets[row]] = flat[offsets[0] : offsets[-1]]
    return out


def _scored(batches, anchors: Anchors, most: float):
    """ids, labels and scores (anchors by rows) of up to ROWS rows at a time."""
    kind = np.float64 if most < 2.0**53 else np.int64
    left, width = anchors.matrix.astype(kind), anchors.matrix.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part["vec_id"].to_numpy(), part["label"].to_numpy(), (left @ _matrix(part["q"], width).astype(kind).T).astype(np.int64)


def _hits(windows: Windows, anchors: Anchors, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray):
    """By 256 windows: the first of them, then windows and columns (rows of the table) of the scores that lie in a window, an anchor's own row left out."""
    own = (labels == anchors.label[:, None]) if windows.same else (labels != anchors.label[:, None])
    own &= ids != anchors.vec_id[:, None]
    for at in range(0, len(windows.anchor), 256):
        a = windows.anchor[at : at + 256]
        s = scores[a]
        w, c = np.nonzero(own[a] & (s >= windows.low[at : at + 256, None]) & (s <= windows.high[at : at + 256, None]))
        yield at, w + at, c, s[w, c]


def _histogram(rows: DataFrame, anchors, windows, shift: int, most: float) -> DataFrame:
    """window, bucket and n: how many scores of each window lie (high - score) >> shift below its upper end."""

    def run(batches):
        w, a = windows.value, anchors.value
        counts = np.zeros(len(w.anchor) * DIGIT, np.int64)
        for ids, labels, scores in _scored(batches, a, most):
            for at, window, _, score in _hits(w, a, ids, labels, scores):
                own = counts[at * DIGIT : (at + 256) * DIGIT]
                own += np.bincount((window - at) * DIGIT + ((w.high[window] - score) >> shift), minlength=len(own))
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part // DIGIT), pa.array(part % DIGIT), pa.array(counts[part])], names=["window", "bucket", "n"])

    return rows.mapInArrow(run, "window long, bucket long, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n"))


def _kth(rows: DataFrame, anchors, windows: Windows, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The kth highest score of each window (its lower end, where it has fewer) and how many of its scores are higher.

    Digit by digit: counts by bucket say in which bucket the kth score is; that bucket is the window of the next digit.
    What comes to the driver is one row for each window of the block.
    """
    spark = rows.sparkSession
    low, high, above = windows.low.copy(), windows.high.copy(), np.zeros(len(windows.low), np.int64)
    live = np.arange(len(low))
    shift = DIGIT_BITS * max(0, (int((high - low).max(initial=0)).bit_length() - 1) // DIGIT_BITS)
    while len(live):
        now = spark.sparkContext.broadcast(Windows(windows.anchor[live], low[live], high[live], windows.same))
        order = Window.partitionBy("window").orderBy("bucket")
        wanted = spark.createDataFrame(pa.table({"window": pa.array(np.arange(len(live))), "rank": pa.array(k - above[live])}))
        found = (
            _histogram(rows, anchors, now, shift, most)
            .withColumn("upto", F.sum("n").over(order))
            .join(F.broadcast(wanted), "window")
            .where("upto >= rank AND upto - n < rank")
            .select("window", "bucket", (F.col("upto") - F.col("n")).alias("higher"))
            .toArrow()
        )
        window, bucket, higher = (found[c].to_numpy() for c in ("window", "bucket", "higher"))
        met = live[window]
        above[met] += higher
        high[met] -= bucket << shift
        low[met] = np.maximum(low[met], high[met] - (1 << shift) + 1)
        live = met  # in the others the kth score doesn't exist: all they hold qualifies
        now.destroy()
        if not shift:
            break
        shift -= DIGIT_BITS
    return low, above


def _best(rows: DataFrame, anchors, windows: Windows, k: int, most: float) -> DataFrame:
    """window, vec_id, score and rank of the k best rows (all, if fewer) of each window: by score from above, then by vec_id.

    Only rows that qualify leave a task: those above the kth score, fewer than k in all, and of those that tie with it the
    task's least vec_ids, as many as are wanted. However many rows tie, no more than that can be among the k.
    """
    low, above = _kth(rows, anchors, windows, k, most)
    state = rows.sparkSession.sparkContext.broadcast((Windows(windows.anchor, low, windows.high, windows.same), k - above))

    def run(batches):
        (w, wanted), a = state.value, anchors.value
        held = [np.zeros(0, np.int64)] * 2
        for ids, labels, scores in _scored(batches, a, most):
            for _, window, column, score in _hits(w, a, ids, labels, scores):
                tied = score == w.low[window]
                if not tied.all():
                    yield pa.RecordBatch.from_arrays([pa.array(window[~tied]), pa.array(ids[column[~tied]]), pa.array(score[~tied])], names=["window", "vec_id", "score"])
                if tied.any():
                    window, found = np.concatenate([held[0], window[tied]]), np.concatenate([held[1], ids[column[tied]]])
                    order = np.lexsort((found, window))
                    window, found = window[order], found[order]
                    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
                    nth = np.arange(len(window)) - np.repeat(first, np.diff(first, append=len(window)))
                    held = [x[nth < wanted[window]] for x in (window, found)]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(w.low[held[0]])], names=["window", "vec_id", "score"])

    best = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(run, "window long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, block: pa.Table, width: int, most: float) -> DataFrame:
    """The result for the anchors of one block."""
    spark = rows.sparkSession
    block = block.combine_chunks().sort_by("vec_id")
    local = Anchors(block["vec_id"].to_numpy(), block["label"].to_numpy(), _matrix(block["q"].combine_chunks(), width))
    anchors = spark.sparkContext.broadcast(local)
    n, bound = len(local.vec_id), math.ceil(most)
    whole = Windows(np.arange(n), np.full(n, -bound), np.full(n, bound), same=True)
    positives = _best(rows, anchors, whole, POSITIVES, most).select("window", "vec_id", "score").toArrow()
    anchor, positive, score = (positives[c].to_numpy() for c in ("window", "vec_id", "score"))
    windows = Windows(anchor, -((-30 * score) // 100), (90 * score) // 100, same=False)
    some = windows.low <= windows.high
    windows = Windows(windows.anchor[some], windows.low[some], windows.high[some], same=False)
    of = spark.createDataFrame(pa.table({"window": pa.array(np.arange(int(some.sum()))), "anchor_id": pa.array(local.vec_id[anchor[some]]), "positive_id": pa.array(positive[some]), "positive_score": pa.array(score[some])}))
    found = _best(rows, anchors, windows, NEGATIVES, most)
    return found.join(F.broadcast(of), "window").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, every: int = 100, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: up to NEGATIVES rows for each anchor and positive.

    Anchors are the rows whose vec_id is divisible by ``every``; their positives the POSITIVES best other rows of their
    label; negatives rows of other labels whose score is from 30 to 90 hundredths of the positive's. Scores are integer
    inner products of what ``quantised`` gives, higher first, ties by the smaller vec_id. See there for nulls, non-finite
    components and repeated rows. A shorter vector lacks components, which count as 0; products of vectors have to stay
    below 2**56 (else ValueError); an empty table gives an empty one; other columns, whatever their names, are not read.

    All anchors meet all rows: blocks of about BLOCK anchors are broadcast one after the other, and each passes over the
    table a few times (one time a digit, and once to gather). No pair is ever a row. For each block the driver holds its
    anchors, their positives and one kth score a window, and a task holds DIGIT counts a window: sizes that are fixed.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // 65536))
    table = scratch.cut(quantised(rows, vec_id, label, vector).repartition(parts, "vec_id"), "rows")
    chosen = F.col("vec_id") % every == 0
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, width, most = table.agg(F.count_if(chosen), F.max(F.size("q")), F.max(square)).first()
    if n and most >= 2.0**56:
        raise ValueError("components are too large for integer scores")
    blocks = -(-n // (BLOCK * 3 // 4)) if n > BLOCK else 1
    of = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(blocks))
    out = [scratch.cut(_mined(table, block, width, most), f"block{b}") for b in range(blocks) if (block := table.where(chosen & (of == b)).toArrow()).num_rows]
    scratch.drop("rows")
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out[0].schema).parquet(*(f"{scratch.root}/{name}" for name in sorted(scratch.names)))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
