"""The training-text pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes all rows that the one before it kept and returns the columns of ``documents``, but for the last, which
returns one row per packed piece. ``run`` writes each stage's rows as Parquet in the shared folder and rereads them, so a
lost executor costs a reread of the last table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import decontaminate, lines, near_dedup, packing, quality
from plotweave.llm._shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the compression bands keep."""
    return quality.quality_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that occurred before; n_chars follows the text. A document of which no line is left goes."""
    return lines.lines_stage(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id."""
    return near_dedup.near_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens and less."""
    return packing.packing_digest(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup_stage), ("decontamination", decontamination), ("packing", pack)]

#: Compression, weighted samples and tokenizer have no SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, str(k))
            if k:
                scratch.drop(str(k - 1))
    return docs
