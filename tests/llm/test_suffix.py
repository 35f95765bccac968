"""Repeated strings against a table of all of them, and merged transforms against sorted suffixes."""

import dataclasses
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plotweave.llm import bwt, suffix_dedup as sd


@pytest.mark.parametrize("seed", range(12))
def test_merge_gives_the_intervals(seed):
    rng = random.Random(seed)
    sequences = [np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 25))], np.int64) for _ in range(rng.randint(0, 30))]
    for depth in (1, 3, 6):
        places = Counter(tuple(s[i : i + depth]) for s in sequences for i in range(len(s) - depth + 1))
        want = {(k, i): tuple(s[i : i + depth]) for k, s in enumerate(sequences) for i in range(len(s) - depth + 1) if places[tuple(s[i : i + depth])] > 1}
        classes, owner, place = bwt.repeated_intervals(sequences, depth, 40)
        got = {(int(o), int(p)): int(c) for c, o, p in zip(classes, owner, place)}
        assert got.keys() == want.keys()
        assert len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in got})


def covered(units, length):
    """For each sequence, the flags of units that a string covers which starts at two places or more."""
    seen = Counter(tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u) + 1, bool)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def brute(texts, length=400, words=50):
    data = [(t or "").encode() for t in texts]
    split = [d.split() for d in data]
    return [
        (len(d), int(g.sum()), len(sd._runs(g)), hashlib.sha256(bytes(b for b, x in zip(d, g) if not x)).hexdigest(), len(sd._runs(w)), int(w.sum()))
        for d, g, w in zip(data, covered(data, length), covered(split, words))
    ]


def corpus(rng):
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [say(n) for n in (380, 399, 400, 401, 450, 900, 2500)]
    texts = [say(rng.randint(0, 900)) + rng.choice(passages) + say(rng.randint(0, 300)) + rng.choice(passages) for _ in range(60)]
    near = say(2500)
    for _ in range(12):
        w = list(near)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        texts.append("".join(w))
    # a passage in many surroundings, so that its anchors have many contexts
    hot = say(430)
    texts += [say(rng.randint(150, 400)) + hot[rng.randint(0, 40) :] + say(rng.randint(150, 400)) for _ in range(30)]
    texts += [texts[3], texts[3], None, "", "short", "a" * 1500, "ab" * 400, "x" + "ab" * 230, passages[5][:399], passages[5][1:401], say(399), say(400)]
    period = say(410)
    return [*texts, period * 4, say(30_000) + passages[6][100:700] + say(200), " ".join(say(30_000).split(" ")[:70]) + "\n\t" + passages[6].replace(" ", "\n "), "one two " * 60]


@pytest.mark.parametrize("many,segment,block", [(512, 1 << 19, 48_000), (1, 700, 50), (6, 5000, 400)])
def test_digest(spark, many, segment, block):
    rule, words = (dataclasses.replace(r, many=many, segment=segment, block=block) for r in (sd.BYTES, sd.WORDS))
    texts = corpus(random.Random(many))
    long = np.frombuffer(max(texts, key=lambda t: len(t or "")).encode(), np.uint8)
    _, first, starts, _ = sd.anchors(long, rule)
    assert first.tolist() == [0, *np.cumsum(starts)[:-1].tolist()] and starts.sum() == len(long) - rule.length + 1 and starts.max() <= rule.width
    rows = [(i if t != "short" else None, t, "a", "b", "c") for i, t in enumerate(texts)]
    got = sd.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string, th string, h string, spans string"), rule, words).collect()
    want = dict(zip((r[0] for r in rows), brute(texts)))
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:]) == want[r.doc_id], (r.doc_id, texts[r.doc_id or 0][:50])


def test_repeated_rows_and_empty(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=500))
    df = spark.createDataFrame([(1, t), (1, t), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, sd.repeats_digest(df).select("doc_id", "n_removed", "n_spans", "n_passages").collect())) == [(1, 500, 1, 1), (1, 500, 1, 1), (2, 0, 0, 0)]
    assert sd.repeats_digest(df.limit(0)).count() == 0


def test_places_are_kept_by_content():
    """Equal strings under unequal anchors' places don't meet; a context given twice is repeated throughout, by its units."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 255, 700).astype(np.uint8)
    other = data.copy()
    other[350] ^= 1
    once, twice = sd.repeated_starts([(data, 150, 301)]), sd.repeated_starts([(data, 150, 301), (data, 150, 301)])
    assert not once[0].any() and twice[0].all() and twice[1].all()
    assert not any(f.any() for f in sd.repeated_starts([(data[:500], 150, 101), (other[:500], 150, 101)]))
