"""Vector layers: well-known text, GeoPackage and shapefile. A layer is a table with an array of (x, y) and a stated reference system."""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
# Fixed value: two systems whose shift is below 0.1 mm count as one.
SAME_SYSTEM = frozenset({31982, 32722})


def require_system(found: int | None, wanted: int) -> None:
    """Refuses a layer without a reference system or in another one; nothing is reprojected."""
    if found is None:
        raise ValueError("the layer has no reference system")
    if found != wanted and not {found, wanted} <= SAME_SYSTEM:
        raise ValueError(f"the layer is in {found}, not in {wanted}")


def parse_wkt(col) -> F.Column:
    """kind and points of POINT, LINESTRING and single-ring POLYGON text, in the JVM; other text gives nulls."""
    kind = F.upper(F.regexp_extract(col, r"^\s*(\w+)", 1))
    body = F.regexp_extract(col, r"\(+([^()]*)\)", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.struct(F.regexp_extract(p, r"^\s*(\S+)", 1).try_cast("double").alias("x"), F.regexp_extract(p, r"^\s*\S+\s+(\S+)", 1).try_cast("double").alias("y")))
    return F.when(kind.isin("POINT", "LINESTRING", "POLYGON"), F.struct(kind.alias("kind"), pairs.alias("points")))


def read_wkt_table(spark: SparkSession, path: str, system: int | None, wanted: int, sep: str = ",") -> DataFrame:
    """A table with one column of well-known text, which is found by its first row; it becomes kind and points."""
    require_system(system, wanted)
    df = spark.read.options(header=True, sep=sep).csv(path)
    first = df.first()
    found = [c for c in df.columns if first is not None and str(first[c]).lstrip().upper().startswith(("POINT", "LINESTRING", "POLYGON"))]
    if len(found) != 1:
        raise ValueError(f"one column of well-known text is needed, found {found}")
    out = df.withColumn("_g", parse_wkt(F.col(found[0]))).drop(found[0])
    return out.select(*(c for c in df.columns if c != found[0]), "_g.kind", "_g.points")


def parse_wkb(data: bytes) -> list[tuple[float, float]]:
    """The points of a point, line, first ring of a polygon, or first part of a multi-geometry."""
    order = "<" if data[0] == 1 else ">"
    kind = struct.unpack_from(order + "I", data, 1)[0]
    extra = (kind & 0x80000000 != 0) or 1000 <= kind % 10000 < 2000
    base = kind % 1000 if kind < 10000 else kind & 0xFF
    size, at = (3 if extra else 2), 5
    if base in (4, 5, 6):
        return parse_wkb(data[9:])
    n = 1
    if base != 1:
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if base == 3:
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
    flat = struct.unpack_from(f"{order}{n * size}d", data, at)
    return [(flat[i], flat[i + 1]) for i in range(0, len(flat), size)]


def strip_header(blob: bytes) -> bytes:
    """The geometry of a GeoPackage blob, whose header has a magic, flags and an optional box."""
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: Sequence[str], wanted: int) -> DataFrame:
    """``columns`` as strings and points of a layer. Spark brings the file's bytes to a task, which opens them from a file of its own for as long as it reads."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("points", POINTS)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with tempfile.TemporaryDirectory() as d:
                    own = os.path.join(d, "layer.gpkg")
                    with open(own, "wb") as out:
                        out.write(content)
                    db = sqlite3.connect(f"file:{own}?mode=ro", uri=True)
                    geom, srs = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                    require_system(srs, wanted)
                    names = ", ".join('"' + c.replace('"', '""') + '"' for c in [*columns, geom])
                    rows = db.execute(f'SELECT {names} FROM "{layer}" ORDER BY rowid')
                    while part := rows.fetchmany(5_000):
                        yield pd.DataFrame([(*(None if v is None else str(v) for v in r[:-1]), [{"x": x, "y": y} for x, y in parse_wkb(strip_header(r[-1]))]) for r in part], columns=schema.names)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def parse_dbf(data: bytes, encoding: str = "latin-1") -> tuple[list[str], list[list[str]]]:
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        at, row = head + i * width + 1, []
        for _, size in fields:
            row.append(data[at : at + size].decode(encoding).strip())
            at += size
        rows.append(row)
    return [f for f, _ in fields], rows


def parse_shp(data: bytes) -> list[list[tuple[float, float]]]:
    """The points of each record's first part; null shapes have none."""
    out, at = [], 100
    while at < len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<I", data, at + 8)[0]
        if kind % 10 == 1:
            out.append([struct.unpack_from("<2d", data, at + 12)])
        elif kind % 10 in (3, 5):
            parts, points = struct.unpack_from("<2I", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
            flat = struct.unpack_from(f"<{points * 2}d", data, at + 52 + 4 * parts)
            out.append(list(zip(flat[::2], flat[1::2]))[starts[0] : starts[1]])
        else:
            out.append([])
        at += 8 + size
    return out


def read_shapefile(spark: SparkSession, stem: str, columns: Sequence[str], system: int | None, wanted: int, geometry: bool = True) -> DataFrame:
    """``columns`` as strings, row (0 and up) and, unless it isn't needed, points of ``stem``.shp and .dbf. Without geometry the .shp isn't read."""
    require_system(system, wanted)
    attrs = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                names, body = parse_dbf(content)
                at = [names.index(c) for c in columns]
                yield pd.DataFrame([(i, *(r[k] for k in at)) for i, r in enumerate(body)], columns=attrs.names)

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame({"row": range(len(s := parse_shp(content))), "points": [[{"x": x, "y": y} for x, y in p] for p in s]})

    read = lambda end: spark.read.format("binaryFile").load(stem + end).select("content")
    out = read(".dbf").mapInPandas(rows, attrs)
    return out.join(read(".shp").mapInPandas(shapes, T.StructType([T.StructField("row", T.LongType()), T.StructField("points", POINTS)])), "row") if geometry else out
