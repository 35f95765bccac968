"""The FM-index and the removal of passages beside plain searches."""

import hashlib
import random
import re
from dataclasses import replace

import numpy as np

from plotweave.llm import substring_dedup
from plotweave.llm.fm_index import FMIndex


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(40):
        kinds, cap = rng.choice([2, 3, 5, 30]), rng.choice([3, 6, 50])
        seqs = [np.array([rng.randint(1, kinds) for _ in range(rng.randint(1, 40))]) for _ in range(rng.randint(1, 12))]
        queries = [np.array([rng.randint(0, kinds + 2) for _ in range(rng.randint(0, 40))], np.int64) for _ in range(8)] + [seqs[0]]
        owners = {}
        for o, s in enumerate(seqs):
            for i in range(len(s)):
                for n in range(1, len(s) - i + 1):
                    owners.setdefault(tuple(s[i : i + n]), set()).add(o)
        index, value = FMIndex(seqs, cap), np.array([rng.randint(0, 99) for _ in seqs])
        least = index.least_owner(value)
        for q, (length, row) in zip(queries, index.matching_statistics(queries)):
            for i in range(len(q)):
                n = 0
                while i + n < len(q) and tuple(q[i : i + n + 1]) in owners:
                    n += 1
                assert min(n, cap) == min(length[i], cap)
                if n >= cap:
                    assert least[row[i]] == min(value[o] for o in owners[tuple(q[i : i + cap])])


def brute(rows, length):
    first = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    order = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        words = split(text)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            first[w] = min(first.get(w, order(doc)), order(doc))
    out = []
    for doc, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < order(doc):
                gone |= set(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(spark, rows, **rule):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, dk string, th string, found string").repartition(5)
    out = substring_dedup.remove_passages(df, replace(substring_dedup.PASSAGES, **rule))
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=repr)


def corpus(rng, n, prose, shared):
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(shared)[rng.randint(0, 30) :] if rng.random() < 0.6 else [rng.choice(prose) for _ in range(rng.randint(0, 90))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


def test_passages_beside_plain_search(spark):
    rng = random.Random(3)
    prose = [f"w{i}é" for i in range(400)] + ["a" * 50]
    shared = [[rng.choice(prose) for _ in range(rng.choice([60, 120, 200]))] for _ in range(4)] + [["same"] * 130]
    rows = corpus(rng, 160, prose, shared)
    rows += [(None, None), (None, " ".join(shared[0])), (500, ""), (501, None), (502, " ".join(shared[1] * 300)), (503, " ".join(shared[2][:49])), (7, rows[7][1]), (7, " ".join(shared[3])), (7, " ".join(shared[3]))]
    assert passages(spark, rows) == brute(rows, 50)


def test_crowded_anchors_are_parted(spark):
    rng = random.Random(5)
    prose = [f"w{i}" for i in range(3000)]
    line = [rng.choice(prose) for _ in range(34)]
    rows = [(i, " ".join([rng.choice(prose) for _ in range(60)] + line + [rng.choice(prose) for _ in range(60)])) for i in range(60)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[30 + i :])) for i in range(0, 60, 3)]
    assert passages(spark, rows, many=4) == brute(rows, 50)


def test_empty_table(spark):
    assert passages(spark, [(1, "a")], many=4)[0][1] == 1
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.passages_digest(df).collect() == []
