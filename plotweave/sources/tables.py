"""Delimited tables as text, their encodings and an inventory of files. Files are read by Spark alone, from any store it opens."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Encodings in the order in which they are tried.
CANDIDATES = ("utf-8", "cp850", "cp1252", "latin-1")


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """All columns as strings; a blank stays an empty string and no text becomes null.

    One-byte encodings that Spark doesn't read are read as ISO-8859-1, which keeps every byte, and their upper half is
    translated by the codec's own table.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    plain = encoding.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
    df = spark.read.schema(schema).options(sep=sep, header=header, encoding=encoding if plain else "ISO-8859-1", emptyValue="", nullValue="\u0001", multiLine=False).csv(path)
    df = df.na.fill("")
    if plain:
        return df
    upper = bytes(range(128, 256))
    return df.select(*(F.translate(c, upper.decode("latin-1"), upper.decode(encoding)).alias(c) for c in columns))


def probe_encoding(data: bytes, candidates: Sequence[str] = CANDIDATES) -> str | None:
    """The first encoding that reads the bytes without an error and without control characters of the upper half."""
    for name in candidates:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if not re.search("[\x80-\x9f]", text):
            return name
    return None


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, lines, sha256 and encoding of each file that ``path`` (a glob) names. Files are read whole, one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            yield pd.DataFrame({"path": f["path"], "bytes": f["length"], "lines": [c.count(b"\n") for c in f["content"]], "sha256": [hashlib.sha256(c).hexdigest() for c in f["content"]], "encoding": [probe_encoding(c) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(run, "path string, bytes long, lines long, sha256 string, encoding string")


def _cell_column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def parse_xlsx(data: bytes, columns: Sequence[str]) -> list[tuple]:
    """Rows of the first sheet of a workbook, of the named columns, as strings; the first row has the names."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(ns + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        rows = []
        for r in ElementTree.fromstring(z.read(sheet)).iter(ns + "row"):
            cells = {}
            for c in r.iter(ns + "c"):
                kind, v = c.get("t"), c.find(ns + "v")
                text = "".join(t.text or "" for t in c.iter(ns + "t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                cells[_cell_column(c.get("r"))] = text
            rows.append(cells)
    names = {v: k for k, v in rows[0].items()} if rows else {}
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return [tuple(r.get(names[c]) for c in columns) for r in rows[1:]]


def _per_file(spark: SparkSession, path: str, parse, schema: T.StructType) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                rows = parse(content)
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_xlsx(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return _per_file(spark, path, lambda data: parse_xlsx(data, columns), schema)


def attach_arrays(spark: SparkSession, df: DataFrame, row: str, check: str, path: str, arrays: Sequence[str]) -> DataFrame:
    """``df`` with columns from an array bundle (npz) whose rows are aligned with ``row``, 0 and up. The bundle's ``check`` array must equal that column bit for bit; a row that differs or is missing raises."""

    def parse(data: bytes) -> list[tuple]:
        with np.load(io.BytesIO(data)) as z:
            return list(zip(range(len(z[check])), z[check].astype(float), *(z[a].astype(float) for a in arrays)))

    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_check", T.DoubleType()), *(T.StructField(a, T.DoubleType()) for a in arrays)])
    out = df.join(_per_file(spark, path, parse, schema), F.col(row) == F.col("_row"), "left")
    same = F.col("_check").isNotNull() & (F.col("_check") == F.col(check).cast("double"))
    guard = F.when(same, F.col(row)).otherwise(F.raise_error(F.concat(F.lit("array row differs: "), F.col(row).cast("string"))).cast(df.schema[row].dataType))
    return out.withColumn(row, guard).drop("_row", "_check")
