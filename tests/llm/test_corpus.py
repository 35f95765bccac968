"""Operators on whole tables: sharding, line dedup, decontamination, archives."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plotweave.llm import decontaminate, lines, near_dedup, quality, sharding, warc

SCHEMA = "doc_id long, text string, source string, start string, shard string, h1 string, n_lines string, w string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def test_sharding(spark):
    rows = [(i, f"text é {i % 7}") for i in range(3000)] + [(None, None), (None, None), (5, "again"), (5, "again"), (7, "")]
    got = sharding.sharding_digest(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by, shard_of = defaultdict(list), {}
    for r in got:
        by[r.shard].append(r.slot)
        assert shard_of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * min(map(len, by.values()))
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.09
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sharding.sharding_digest(docs(spark, rows).limit(0)).count() == 0


def test_sharding_weights(spark):
    df = docs(spark, [(i, "t") for i in range(8000)])
    n = {r["shard"]: r["count"] for r in sharding.shard_records(df, weights=(1.0, 3.0), grown=None).groupBy("shard").count().collect()}
    assert 2.6 < n[1] / n[0] < 3.4
    with pytest.raises(ValueError):
        sharding.shard_records(df, weights=(1.0, 0.0))


def brute_lines(rows):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[doc] = (0, 0, "")
            continue
        all_lines = text.split("\n")
        at = [i for i, x in enumerate(all_lines) if re.search(r"[^ \t-\r]", x)]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(all_lines[i] for i in at[k : k + 3])
            if seen.setdefault(w, (doc, k)) != (doc, k):
                gone |= set(at[k : k + 3])
        out[doc] = (len(at), len(gone), "\n".join(x for i, x in enumerate(all_lines) if i not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c", "", " \t", "d", "dé"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(None, "a\nb b\nc\nd"), (500, None), (501, ""), (502, "\n" * 5000), (503, "x y\n" * 4000), (504, "x y\n" * 4000), (505, "a\nb b\nc")]
    rows += rows[:3]
    got = lines.lines_digest(docs(spark, rows)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), r
    stage = lines.lines_stage(docs(spark, rows))
    assert stage.columns == docs(spark, rows).columns
    assert sorted(t or "" for (t,) in stage.select("text").collect()) == sorted(want[d][2] for d, _ in rows if want[d][1] == 0 or want[d][1] < want[d][0])
    assert lines.lines_digest(docs(spark, rows).limit(0)).count() == 0


def brute_hits(rows, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = {}
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["The", "of", "é", "b2", "cat", "DOG", "x", "y", "z", "Ünit"]) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(90, None), (91, "--"), (92, "Solo"), (None, "null item words go here for a test of ten and more"), (93, "go the the the the the the the the the the the the")]
    rows = [(i, say(rng.randint(0, 60)) + rng.choice([" ", ", "]) + (rng.choice(items)[1] or "") + "! " + say(5)) for i in range(60)]
    rows += [(None, items[4][1]), (700, None), (701, ""), (702, say(20_000)), (703, "solo"), (704, "the " * 300)]
    got = decontaminate.decontamination_digest(docs(spark, rows + rows[:2]), spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, win string")).collect()
    want = brute_hits(rows, items)
    assert len(got) == len(rows) + 2
    for r in got:
        assert tuple(r[1:]) == want[r.doc_id], r
    stage = decontaminate.decontamination_stage(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in stage.collect()) == sorted(str(d) for d, w in want.items() if not w[4])
    none = spark.createDataFrame([], "item_id long, text string")
    assert not [r for r in decontaminate.decontamination_digest(docs(spark, rows), none).collect() if r.contaminated]
    assert decontaminate.decontamination_digest(docs(spark, rows).limit(0), none).count() == 0


def brute_pages(rows):
    top = defaultdict(lambda: None)
    for page, _, html in rows:
        if page is not None and (top[html or ""] is None or page > top[html or ""]):
            top[html or ""] = page
    out = []
    for page, _, html in rows:
        b, t = (html or "").encode(), top[html or ""]
        revisit = len(b) >= 1000 and t is not None and page != t
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", t if revisit else None))
    return out


def test_warc(spark, monkeypatch):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 60_000
    rows = [(1, "http://a b/\r\n", big), (2, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "y" * 1000), (6, "u", "y" * 1000), (None, "u", "y" * 1000), (7, "u", None), (8, "u", ""), (9, "u", "\r\n\r\n"), (6, "u", "y" * 1000), (None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, warc.warc_digest(df).collect()), key=key) == sorted(brute_pages(rows), key=key)
    assert warc.warc_digest(df.limit(0)).count() == 0
    chunks = [r for r in warc.archive_pages(df).collect() if r.page_id == 2]
    assert len(chunks) > 3 and b"".join(r.data for r in sorted(chunks, key=lambda r: r.chunk)) == big.encode()
    for r in chunks:
        assert r.digest_so_far == hashlib.sha1(big.encode()[: r.bytes_so_far]).hexdigest()
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    assert sorted(map(tuple, warc.warc_digest(df).collect()), key=key) == sorted(brute_pages(rows), key=key)


CLASHING = ("n_lines", "n_removed", "kept_text", "_lines", "_at", "_gone", "_id", "_th", "_ranks", "row", "a.b", "fps", "w", "g", "h1", "h2", "node", "n_words", "kept", "_k", "_1")


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "decontamination"])
def test_stages_carry_columns_of_any_name(spark, stage):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(700)]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=14)) for _ in range(9))) for i in range(30)]
    rows += [(40, rows[0][1]), (41, rows[1][1] + "\nmore"), (42, "\n".join(rows[2][1].split("\n")[:4]) + "\n" + rows[3][1]), (43, None), (44, "")]
    names = ["doc_id", "n_chars", *CLASHING, "text"]
    df = spark.createDataFrame([(d, -1, *(f"{d} {c}" for c in CLASHING), t) for d, t in rows], "doc_id long, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING) + ", text string")
    items = spark.createDataFrame([(1, " ".join(rows[5][1].split()[:12]))], "item_id long, text string")
    run = {"quality": quality.quality_stage, "lines": lines.lines_stage, "near": near_dedup.near_stage, "decontamination": lambda d: decontaminate.decontamination_stage(d, items)}[stage]
    plain = {r.doc_id: r.text for r in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    out = run(df)
    assert out.columns == names
    got = [tuple(r) for r in out.collect()]
    assert {r[0]: r[-1] for r in got} == plain and 0 < len(got) <= len(rows)
    assert all(r[2:-1] == tuple(f"{r[0]} {c}" for c in CLASHING) for r in got)
