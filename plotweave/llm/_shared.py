"""What the operators share: scratch tables in the cluster's shared folder, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset (tests on local masters) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plotweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", set()

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        self.names -= set(names)
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which the result still reads."""
        self.drop(*(self.names - set(names)))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``max_bytes`` (a longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and row, the other columns of ``docs`` as a struct: whatever their names, none is in the way of an operator's own."""
    others = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("row"))


def restored(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns ``names`` of what was ``carried``, those in ``new`` replaced."""
    return df.select(*(column_of(c, **new).alias(c) for c in names))


def column_of(name: str, **new: Column) -> Column:
    return new[name] if name in new else F.col(name) if name in ("doc_id", "text") else F.col("row")[name]


def keys_only(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys and text alone, so that other columns, whatever their names, are neither read nor in the way."""
    return df.select(*keys, *([] if text in keys else [text]))
