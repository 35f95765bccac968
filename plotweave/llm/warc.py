"""WARC archives as a chunked record table: written and read in pieces, with digests carried from chunk to chunk."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import Scratch, keys_only

# Below so many bytes equal payloads stay whole records.
LEAST_REVISIT = 1000
CHUNK = 256 << 10
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 1 << 30

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("stated_bytes", T.LongType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("digest_so_far", T.StringType()),
        T.StructField("last", T.BooleanType()),
    ]
)
_RECORD_PA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])


def record_name(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")


def header(page_id, url, digest: str, size: int, refers_to) -> bytes:
    """The lines of a record up to its payload. A revisit has none; its payload's size and digest stand in the header."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_name(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_name(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, refers_to.

    Of equal payloads of LEAST_REVISIT bytes or more the one with the largest page_id stays a response and the others
    revisit it. The digests of repeated payloads are found by a partial aggregation over digest and size; only the
    (page_id, target) rows of revisits meet the pages again, so a payload that a third of the pages hold is no hot key.
    """
    sized = lambda df: df.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    small = sized(base).where(f"payload_bytes >= {LEAST_REVISIT}").select("page_id", "payload_bytes", "digest")
    groups = small.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    revisits = small.join(groups, ["digest", "payload_bytes"]).where("NOT page_id <=> refers_to").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    full = sized(base)
    return full.join(revisits, full["page_id"].eqNullSafe(F.col("_id")) & (full["digest"] == F.col("_digest")), "left").select("page_id", "url", "html", "payload_bytes", "digest", "refers_to")


def write_archives(plan: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Write gzip archives under ``folder`` (any store that pyarrow opens by URI) and return the lazy manifest of files.

    Each task writes files of its own, with the attempt in their names, and a file counts only through its manifest row:
    what a lost or repeated attempt leaves behind is never read. A payload goes through compression chunk by chunk.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink = None
        task = TaskContext.get()
        files = 0

        def start():
            nonlocal files
            name = f"{root}/part-{task.partitionId():06d}-{files:03d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
            files += 1
            return [name, store.open_output_stream(name, compression=None), 0, 0]

        def member(pieces: Iterator[bytes]) -> None:
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for piece in pieces:
                if out := z.compress(piece):
                    sink[3] += sink[1].write(out) or len(out)
            out = z.flush()
            sink[1].write(out)
            sink[3] += len(out)
            sink[2] += 1

        def close():
            sink[1].close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{sink[0].rsplit('/', 1)[1]}"], "records": pa.array([sink[2]], pa.int64()), "bytes": pa.array([sink[3]], pa.int64())})

        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "html", "payload_bytes", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, _, size, digest, refers_to = (None if c is columns[2] else c[i].as_py() for c in columns)
                payload = memoryview(columns[2][i].as_buffer())
                if sink is None:
                    sink = start()

                def pieces():
                    yield header(page_id, url, digest, size, refers_to)
                    if refers_to is None:
                        for at in range(0, len(payload), chunk):
                            yield payload[at : at + chunk]
                    yield b"\r\n\r\n"

                member(pieces())
                if sink[3] >= FILE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return plan.mapInArrow(run, MANIFEST)


class _Members:
    """Reads lines and bounded runs of bytes from a file of gzip members."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.buffer, self.z, self.rest = stream, step, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        data = self.rest or self.stream.read(self.step)
        if not data:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(data, self.step)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        at = 0
        while (end := self.buffer.find(b"\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 1)
            if not self._more():
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in runs of at most ``step``."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("a record ends early")
            out = bytes(self.buffer[: min(n, self.step)])
            del self.buffer[: len(out)]
            n -= len(out)
            if out:
                yield out


def read_records(stream, step: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive: the fields of RECORD. A revisit or an empty payload gives one row without data."""
    source = _Members(stream, step)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while line := source.line():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        while (line := source.line()) is not None:  # the HTTP header
            left -= len(line) + 2
            if not line:
                break
        number = lambda name: int(fields[name]) if name in fields else None
        row = {
            "page_id": number("x-page-id"),
            "url": fields.get("warc-target-uri"),
            "record_id": fields["warc-record-id"].strip("<>"),
            "record_type": fields["warc-type"],
            "refers_to": number("x-refers-to-page-id"),
            "stated_bytes": int(fields["x-payload-length"]),
            "stated_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
        }
        digest, seen, k, held = hashlib.sha1(), 0, 0, b""
        for part in source.take(left):
            if held:
                yield row | {"chunk": k, "data": held, "bytes_so_far": seen, "digest_so_far": digest.hexdigest(), "last": False}
                k += 1
            digest.update(part)
            seen, held = seen + len(part), part
        yield row | {"chunk": k, "data": held, "bytes_so_far": seen, "digest_so_far": digest.hexdigest(), "last": True}


def read_archives(manifest: DataFrame, step: int = CHUNK) -> DataFrame:
    """The chunked record table of the manifest's files: RECORD, one row per chunk."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for row in read_records(stream, step):
                        rows.append(row)
                        held += len(row["data"])
                        if held >= 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD_PA)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD_PA)

    return manifest.select("path").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and return the chunked record table read back from them.

    Null html is an empty payload; a null url is written as ``urn:none``; a null page_id has no X-Page-Id line and comes
    back as null; pages with equal page_id and payload are all responses if theirs is the largest; other columns are
    dropped; an empty table writes no file. A record is handled in chunks of CHUNK bytes, so its size doesn't set memory.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    plan = plan_records(keys_only(pages, ["page_id", "url"], "html"))
    manifest = scratch.cut(write_archives(plan, f"{scratch.root}/archives"), "manifest")
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(files, F.col("path")) if files > 1 else manifest)


def warc_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives: the digest of a response is that of the bytes read, and a mismatch with its header fails the query."""
    wrong = F.raise_error(F.concat(F.lit("payload differs from its header: "), F.col("record_id"))).cast("string")
    checked = F.when((F.col("record_type") == "revisit") | (F.col("digest_so_far") == F.col("stated_digest")), F.col("stated_digest")).otherwise(wrong)
    return archive_pages(pages).where("last").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to"
    )


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
