"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontaminate, lines, near_dedup, negatives, packing, quality, secrets, sharding, substring_dedup, suffix_dedup, tokens, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_read(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_digest(_read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_digest(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_digest(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(_read(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages_digest(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_minhash_near_dedup, op4_sharding, op5_line_dedup, op6_suffix_dedup, op7_token_counts, op8_decontamination, op9_warc, op10_packing, op11_hard_negatives, op12_filter_audit, op13_substring_dedup)}
ORACLE_SQL = {"op5_line_dedup": lines.LINES_SQL, "op8_decontamination": decontaminate.DECONTAMINATION_SQL, "op9_warc": warc.WARC_SQL, "op11_hard_negatives": negatives.NEGATIVES_SQL, "op12_filter_audit": audit.AUDIT_SQL}
