"""Quality rules: word and line measures, and bands of zstandard compression ratios."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from ._shared import carried, keys_only, restored, slices

WHITE = b" \t\n\x0b\x0c\r"
# The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

#: From so many bytes on: the least and the largest ratio of compressed to raw bytes of a whole document. Short texts
#: hold little to repeat and pay for the frame, so their band is wider at the top.
WHOLE_BANDS = ((0, 0.0, 9.0), (200, 0.22, 0.90), (500, 0.20, 0.80), (2_000, 0.18, 0.75), (8_000, 0.16, 0.72), (32_000, 0.12, 0.70))
#: Fixed chunks of texts of at least a chunk's length, and their band; the last chunk ends with the text, so that no byte
#: is left out. A shorter text is judged as a whole.
CHUNK, CHUNK_BAND = 4096, (0.12, 0.75)
#: A document is also rejected when more than this share of its chunks leaves the band of chunks.
CHUNK_SHARE = 0.5
LEVEL = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_zstd_bytes", "n_chunks", "n_bad_chunks")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        if w in seen:
            twice.add(w)
        seen.add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: bytes | None, squeeze: zstandard.ZstdCompressor) -> list[int]:
    """The values of MEASURES. bytes.split() parts at exactly space and the codes 9 to 13, as the word pattern does."""
    text = text or b""
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line and line.strip():
            dup += line in seen
            seen.add(line)
    plain = text.translate(None, WHITE)
    starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK] if len(text) >= CHUNK else []
    chunks, bad = len(starts), 0
    for at in starts:
        bad += not CHUNK_BAND[0] <= len(squeeze.compress(text[at : at + CHUNK])) / CHUNK <= CHUNK_BAND[1]
    return [len(words), len(plain.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words), len(text), len(squeeze.compress(text)) if text else 0, chunks, bad]


def quality_measures(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and MEASURES for every row, in one pass without a shuffle.

    Null texts count as empty; repeated rows each get the same measures; an empty table gives an empty one; a very long
    text is held by itself, one at a time; other columns, whatever their names, are dropped.
    """
    keys = list(keys)
    df = keys_only(docs, keys, text)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch, text):
                rows = [measure(t, squeeze) for t in part[text].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*keys, *MEASURES])

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def judge(measured: DataFrame) -> DataFrame:
    """Add base_failed, ratio, band_failed and kept: the thresholds are expressions, so they can change without a rescan."""
    low = "CASE " + " ".join(f"WHEN n_bytes >= {n} THEN {a}D" for n, a, _ in reversed(WHOLE_BANDS)) + " END"
    high = "CASE " + " ".join(f"WHEN n_bytes >= {n} THEN {b}D" for n, _, b in reversed(WHOLE_BANDS)) + " END"
    return (
        measured.selectExpr("*", f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed", "CASE WHEN n_bytes = 0 THEN 1D ELSE n_zstd_bytes / CAST(n_bytes AS DOUBLE) END AS ratio")
        .selectExpr("*", f"ratio NOT BETWEEN {low} AND {high} OR n_bad_chunks > {CHUNK_SHARE}D * n_chunks AS band_failed")
        .selectExpr("*", "NOT base_failed AND NOT band_failed AS kept")
    )


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then the compression measures."""
    return judge(quality_measures(docs)).select("doc_id", *MEASURES[:5], "base_failed", "kept", *MEASURES[5:], "band_failed")


def quality_stage(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns, whatever their names. Null and empty texts go, as they have no words; repeated rows stay or go together."""
    return restored(judge(quality_measures(carried(docs), "text", ("row", "doc_id", "text"))).where("kept"), docs.columns)
