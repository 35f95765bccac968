"""Where results go: tables in a total order, manifests, Markdown."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One sorted file with a header, for result tables of report size."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], parts: int = 1) -> str:
    """Parquet in a total order, and a digest of the rows that depends on neither files nor their order."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return content_hash(df.sparkSession.read.parquet(path))


def content_hash(df: DataFrame) -> str:
    """Rows and two sums of their 64-bit hashes: equal tables are equal in any order and partitioning."""
    cols = sorted(df.columns)
    n, a, b = df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(20,0)")) for seed in (1, 2))).first()
    return f"{n}:{a}:{b}"


def write_manifest(df: DataFrame, path: str) -> None:
    """A JSON object per row, keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def manifest_text(values: dict) -> str:
    return json.dumps(values, sort_keys=True, indent=2, ensure_ascii=False)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of report size as Markdown; whole floats lose their point, nulls are blank, bars are escaped."""
    rows = df.limit(most).collect()

    def cell(v) -> str:
        if v is None:
            return ""
        if isinstance(v, float):
            return f"{v:.0f}" if v == int(v) and abs(v) < 1e15 else f"{v:.6g}"
        return str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def report(title: str, sections: Sequence[tuple[str, str | DataFrame]], most: int = 200) -> str:
    """A Markdown report: each section's heading over its text, or over its table of report size."""
    parts = [f"# {title}"]
    for heading, body in sections:
        parts += [f"## {heading}", body if isinstance(body, str) else markdown(body, most)]
    return "\n\n".join(parts) + "\n"


def label_columns(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Value columns get a variant's label, so that variants can be joined side by side."""
    return df.select(*keys, *(F.col(c).alias(f"{c}_{label}") for c in df.columns if c not in keys))


def side_by_side(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    out = None
    for label, df in frames.items():
        one = label_columns(df, keys, label)
        out = one if out is None else out.join(one, list(keys), "left")
    return out
