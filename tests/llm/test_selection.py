"""Hard negatives and the filter audit beside plain computations."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from plotweave.llm import audit, negatives

VECTORS = "vec_id long, embedding array<float>, label int, q string, score string, rank string, window string"


def brute_negatives(rows):
    def takes_part(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[1])

    known = {}
    for vec_id, vector, label in filter(takes_part, rows):
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        entry = (label, [math.floor(256 * x) for x in vector])
        known[vec_id] = min(known.get(vec_id, entry), entry)
    out = []
    for a, (label, q) in known.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, other)), b, own) for b, (own, other) in known.items() if b != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            near = [(n, -t) for t, n, own in scores if own != label and -30 * s <= -100 * t <= -90 * s][:10]
            out += [(a, p, k, n, -s, t) for k, (n, t) in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, dim, values):
    return [(i, [rng.choice(values) for _ in range(dim)], rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("block", [1024, 3])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = random.Random(block)
    rows = vectors(rng, 900, 6, [0.5, 0.25, -0.125, 0.9, 0.0])  # few values: many ties
    rows += [(-100 * i, [rng.uniform(-1, 1) for _ in range(6)], rng.randint(0, 9)) for i in range(1, 5)]
    rows += [(2000 + i, [0.5] * 6, i % 3) for i in range(300)]  # one vector many times
    rows += [(None, [1.0] * 6, 1), (5000, None, 1), (5100, [1.0] * 6, None), (5200, [1.0, None] * 3, 2), (5300, [float("nan")] * 6, 2), (5400, [float("inf")] * 6, 2), (5500, [1.0, 2.0], 3), (5600, [], 3)]
    rows += [rows[100], rows[200], (300, [0.0] * 6, 5), (400, [0.1] * 6, 2)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS).repartition(4)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df).collect())
    want = brute_negatives([(i, v and [x if x is None else spark_float(x) for x in v], label) for i, v, label in rows])
    assert got == want and len(got) > 100
    assert negatives.hard_negatives(df.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.hard_negatives(df.limit(0)).collect() == []


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def test_long_scores(spark):
    """Products beyond what doubles hold exactly are added as whole numbers, and scores no long holds are refused."""
    rng = random.Random(2)
    big = [(i, [rng.uniform(-1, 1) * 2.0**18, rng.uniform(0.9, 1) * 2.0**19], i % 3) for i in range(101)]
    schema = "vec_id long, embedding array<double>, label int"
    assert sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(big, schema)).collect()) == brute_negatives(big)
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e30], 1)], schema))


def brute_audit(docs, labels):
    out = []
    text_of = lambda t: t or ""
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text_of(text)] = min(first.get(text_of(text), doc), doc)
    mark = lambda name: {d for d, *flags in labels if flags[name] == 1}
    good, toxic = mark(0), mark(1)
    fails = []
    for doc, text, source in docs:
        t = text_of(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((doc, source or "", {k for k, f in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc is not None and doc > first[t])) if f}))
    for part in {p for _, p, _ in fails}:
        rows, shapley = [(d, f) for d, p, f in fails if p == part], Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[1]]
                shapley[k] += len(gone)
                redundant = sum(k in f for _, f in rows) - len(gone)
                left = [r for r in left if k not in r[1]]
                steps.append((part, order, step, len(left), len(gone), redundant, sum(f == {k} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(6)
    words = ["a", "B", "cé", "D$", "e|f", "Ghi", *(f"w{i}" for i in range(80))]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(60)] + [" ".join(f"w{i}" for i in range(60))] * 3 + ["x " * 20_000, "", None, " \t\n", "A" * 30, "é" * 5]
    docs = [(i, t, rng.choice(["s1", "s2", "s2", None, ""])) for i, t in enumerate(texts * 2)] + [(None, "", "s1"), (None, texts[3], "s2"), (5, texts[5], "s1"), (5, texts[5], "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    d = spark.createDataFrame([(*r, "x", "x", "x") for r in docs], "doc_id long, text string, source string, mask string, part string, first string").repartition(3)
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.filter_audit(d, lab)
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, [r for r in labels if r[0] is not None])
    assert audit.filter_audit(d.limit(0), lab).collect() == []
    assert audit.filter_audit(d, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
