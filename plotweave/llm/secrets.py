"""Secret scan: fixed patterns, and windows of high Shannon entropy in candidate strings."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import keys_only, slices

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: kind, run of the class, window, bits a character, what a flagged window's run must hold
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0, (r"[0-9]", r"[a-fA-F]")),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.75, (r"[0-9].*[0-9]", r"[A-Z]", r"[a-z]")),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.75, (r"[0-9].*[0-9]", r"[A-Z]", r"[a-z]", r"[+/_=-]")),
)
#: A run of letters and digits in a candidate is not scanned when one of these matches in it; a candidate isn't when one
#: of these labels stands before it (quotes, white space of any length and a separator may lie between), or when it lies in
#: the host or path of a URL. What stands before the host's @, and what follows the path, is scanned.
ALLOW_INSIDE = tuple(re.compile(p, re.I) for p in (r"example|sample|placeholder|dummy|changeme|your[_-]?(key|token)", r"^(.)\1*$", r"0123456789|abcdefghij"))
ALLOW_LABELS = ("sha1", "sha224", "sha256", "sha384", "sha512", "md5", "integrity", "checksum", "commit", "uuid")
SCHEME = "://"
#: Ends the path: a query, a fragment, the next field of a query that holds the URL, or what can't be in one.
PATH_END = re.compile(r"""[?#&"'`<>\\{}|^,]""")
#: What lies between white space and may hold a candidate.
TOKEN = re.compile(r"\S{20,}")

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), True)
_SPAN_PA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def windows_over(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``width`` characters whose entropy reaches ``bits``.

    A step of the window changes two counts, so the sum of c*log2(c) is kept up to date in constant time.
    """
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    most = width * (math.log2(width) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c] if c < width else 0.0
        counts[ch] = c + 1
        if i < width - 1:
            continue
        if total <= most:
            begin = i - width + 1
            if begin > end >= 0:
                yield start, end
                start = begin
            elif start < 0:
                start = begin
            end = i + 1
        out = run[i - width + 1]
        c = counts[out]
        total += clog[c - 1] - clog[c]
        counts[out] = c - 1
    if end >= 0:
        yield start, end


def _without_allowed(word: str) -> str:
    """The candidate with blanks for each run of letters and digits that holds (part of) a match of the allow-list."""
    marked = None
    for p in ALLOW_INSIDE:
        done = 0
        for m in p.finditer(word):
            a, b = m.span()
            if b <= done:
                continue
            marked = marked or list(word)
            while a > done and word[a - 1].isalnum():
                a -= 1
            while b < len(word) and word[b].isalnum():
                b += 1
            marked[a:b] = " " * (b - a)
            done = b
    return "".join(marked) if marked else word


def entropy_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Every class scans each candidate; spans that spans of narrower classes cover are left out."""
    for token in TOKEN.finditer(text):
        for start, end in _outside_paths(text, token.start(), token.end()):
            yield from _candidate_spans(text, start, end)


def _outside_paths(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The pieces of a run without white space that aren't the host and path of a URL."""
    while (scheme := text.find(SCHEME, start, end)) >= 0:
        yield start, scheme
        host = scheme + len(SCHEME)
        found = PATH_END.search(text, host, end)
        start = found.start() if found else end
        slash = text.find("/", host, start)
        at = text.rfind("@", host, slash if slash >= 0 else start)
        if at >= 0:
            yield host, at
    yield start, end


def _labelled(text: str, at: int) -> bool:
    """Whether a label of the allow-list, maybe with a separator, ends before ``at``."""
    for between in ("\"'", None, ":=-", None, "\"'"):
        if between is None:
            while at and text[at - 1].isspace():
                at -= 1
        elif at and text[at - 1] in between:
            at -= 1
    return text[max(0, at - 9) : at].lower().endswith(ALLOW_LABELS)


def _candidate_spans(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    for found in CANDIDATE.finditer(text, start, end):
        at = found.start()
        if _labelled(text, at):
            continue
        word = _without_allowed(found[0])
        narrower: list[tuple[int, int]] = []
        for kind, pattern, width, bits, needs in CLASSES:
            spans = [(at + run.start() + a, at + run.start() + b) for run in pattern.finditer(word) if all(re.search(n, run[0], re.S) for n in needs) for a, b in windows_over(run[0], width, bits)]
            new = [s for s in spans if not _covered(s, narrower)]
            yield from ((kind, a, b) for a, b in new)
            narrower = _union(narrower + new)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, with those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(span: tuple[int, int], union: list[tuple[int, int]]) -> bool:
    at = bisect.bisect_right(union, (span[0], math.inf)) - 1
    return at >= 0 and union[at][1] >= span[1]


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start and then by the order of KINDS."""
    if not text:
        return []
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans += entropy_spans(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and ``spans``, an array of (kind, start, end), for every row.

    Null texts count as empty; repeated rows stay; spans that start together keep the order of KINDS, and of one kind the
    shorter comes first; other columns are dropped; an empty table gives an empty one. One pass without a shuffle: a row
    needs nothing of any other, and a text, however long, is held once at a time.
    """
    keys = list(keys)
    df = keys_only(docs, keys, text)

    def scan(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in part[text].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(found, _SPAN_PA)], names=[*keys, "spans"])

    return df.mapInArrow(scan, T.StructType([*(df.schema[k] for k in keys), T.StructField("spans", SPAN)]))


def joined(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``scan_secrets``."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_entropy")
    )
