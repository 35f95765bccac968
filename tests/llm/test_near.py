"""Near-duplicate classes against all pairs."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from plotweave.llm import components, near_dedup as nd
from plotweave.llm._shared import Scratch

SCHEMA = "doc_id long, text string, node string, h1 string, bucket string, sig string"


def corpus(rng):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: rng.choices(words, k=n)

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        return w

    texts = []
    for n, copies, edits in ((150, 6, 2), (400, 20, 3), (60, 8, 1), (200, 40, 9)):
        base = say(n)
        texts += [base, *(edit(base, rng.randint(0, edits)) for _ in range(copies))]
    shared = say(60)
    texts += [say(100) + shared + say(100) for _ in range(25)]
    texts += [say(rng.randint(1, 300)) for _ in range(60)]
    out = [" ".join(t) for t in texts]
    out += [out[0].upper() + "!", out[3], out[3], "", "", "#!", "?!", "one two", "Two one", "ONE, two", say(1)[0], "x " * 20_000]
    rng.shuffle(out)
    return out


def brute(texts, idf):
    values, counts, bounds = nd.shingles(pa.array(texts))
    weights = counts * idf[nd.bucket_of(values)]
    own = [(values[a:b], weights[a:b]) for a, b in zip(bounds, bounds[1:])]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sure = True
    for i, j in itertools.combinations(range(len(texts)), 2):
        s = nd.similarity(own[i], own[j])
        if texts[i] == texts[j] or s >= nd.LEAST:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], sure


def test_classes(spark):
    texts = corpus(random.Random(11))
    rows = [(i, t, "n", "h", "b", "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    idf = nd.idf_weights(df)
    assert 1 <= idf.min() and idf.max() <= 2
    want, _ = brute(texts, idf)
    got = {r.doc_id: r.class_id for r in nd.near_digest(df).collect()}
    missed = [i for i in range(len(texts)) if got[i] != want[i]]
    assert len(got) == len(texts) and len(missed) <= 1, [(i, got[i], want[i]) for i in missed]
    stage = nd.near_stage(df)
    assert stage.columns == df.columns and stage.count() == len(set(got.values()))


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g", *"nhbs"), (1, "a b c d e f g", *"nhbs"), (1, "a b c d e f g", *"nhbs"), (2, None, *"nhbs"), (3, None, *"nhbs"), (4, "", *"nhbs"), (None, None, *"nhbs"), (5, "other text of its own here", *"nhbs")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nd.near_digest(df).collect()
    assert len(got) == len(rows)
    stage = nd.near_stage(df).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in stage) == [("4", ""), ("5", "other text of its own here"), ("None", "None"), ("None", "a b c d e f g")]
    assert nd.near_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_samples_estimate_similarity(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(400)]
    errors = []
    for k in (5, 15, 30, 60):
        b = list(a)
        for _ in range(k):
            b[rng.randrange(400)] = "zz" + rng.choice("qrst")
        values, counts, bounds = nd.shingles(pa.array([" ".join(a), " ".join(b)]))
        weights = counts * (1 + (values % np.uint64(7)).astype(float) / 7)
        sig = nd.signatures(values, weights, bounds)
        true = nd.similarity((values[: bounds[1]], weights[: bounds[1]]), (values[bounds[1] :], weights[bounds[1] :]))
        errors.append(abs((sig[0] == sig[1]).mean() - true))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.12


@pytest.mark.parametrize("size", (2_000, 100_000))
def test_samples_of_long_texts_with_uneven_counts(size):
    """A passage of 4% that one text holds five times: similarity 1 / 1.16, whatever the length."""
    rng = np.random.default_rng(size)
    agree = []
    for _ in range(6):
        values = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        once, more = np.ones(size), np.ones(size)
        more[rng.permutation(size)[: size // 25]] = 5
        sig = nd.signatures(np.append(values, values), np.append(once, more), np.array([0, size, 2 * size]))
        agree.append((sig[0] == sig[1]).mean())
    assert abs(sum(agree) / 6 - 1 / 1.16) < 0.08, agree


def test_samples_do_not_depend_on_the_bound(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.append(rng.integers(0, 4, 200), rng.integers(50, 900, 40))
    values, bounds = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64), np.append(0, np.cumsum(sizes))
    weights = rng.integers(1, 9, len(values)) * (1 + rng.random(len(values)))
    sig = nd.signatures(values, weights, bounds)
    monkeypatch.setattr(nd, "ENOUGH", 1e9)
    assert (sig == nd.signatures(values, weights, bounds)).all()


def vector(words, part, node):
    values, counts, _ = nd.shingles(pa.array([" ".join(words)]))
    return (node, part, values, counts.astype(np.int32))


@pytest.mark.parametrize("seed", range(4))
def test_blocks_against_all_pairs(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(300)]
    idf = (1 + np.random.default_rng(seed).random(1 << nd.IDF_BITS)).astype(np.float32)
    texts = []
    for n in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(300)] = "z" + str(rng.randint(0, 40))
        if n % 9 == 0:
            w += w[:50] * 3
        texts.append(vector(w, rng.randrange(40), n))
    texts.append(vector(["one"], 99, 99))
    own = {t[0]: (t[2], t[3] * idf[nd.bucket_of(t[2])]) for t in texts}

    def parts(links):
        root = {t[1]: t[1] for t in texts}
        find = lambda i: i if root[i] == i else find(root[i])
        part = {t[0]: t[1] for t in texts}
        for a, b in links:
            root[find(part[a])] = find(part[b])
        return sorted(sorted(n for n in part if find(part[n]) == r) for r in {find(p) for p in part.values()})

    for left, right in ((texts, None), (texts[:30], texts[30:])):
        pairs = itertools.combinations(left, 2) if right is None else itertools.product(left, right)
        want = [(x[0], y[0]) for x, y in pairs if x[1] != y[1] and nd.similarity(own[x[0]], own[y[0]]) >= nd.LEAST]
        got = nd.block_links(left, right, idf)
        assert {(a, b) for a, b, _ in got} <= set(want) and all(abs(s - nd.similarity(own[a], own[b])) < 1e-12 for a, b, s in got)
        assert parts((a, b) for a, b, _ in got) == parts(want) and len(got) < 71


def test_a_bucket_of_unlinked_texts_is_blocks_not_pairs(spark):
    """2,000 texts of one bucket, each a part of its own: rows grow by the number of blocks, and the one link between parts is found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(40)]
    texts = [base[:30] + [word() for _ in range(30)] for _ in range(2_000)]
    texts[1_700] = texts[3][:-1] + ["x"]
    idf = np.ones(1 << nd.IDF_BITS, np.float32)
    component = spark.createDataFrame([(7, n, 56, n) for n in range(2_000)], "bucket long, node long, size long, part long")
    vectors = nd._vectors(spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "node long, text string"))
    assert [(sorted((a, b)), round(s, 2)) for a, b, s in nd._open_links(component, vectors, idf, Scratch(spark, "t")).collect()] == [([3, 1_700], 0.96)]


def test_links_name_a_similar_text(spark):
    texts = corpus(random.Random(2))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = nd.idf_weights(df)
    own = nd._own(pa.array(texts), idf)
    for r in nd.near_digest(df).collect():
        if r.link_id is not None:
            assert abs(nd.similarity(own[r.doc_id], own[r.link_id]) - r.link_similarity) < 1e-9 and r.link_similarity >= nd.LEAST
        assert r.link_id is not None or r.class_id == r.doc_id or texts[r.class_id] == texts[r.doc_id]


def test_weights_follow_document_frequencies(spark):
    rng = random.Random(8)
    texts = [" ".join(["the very same opening words"] * (i % 3 == 0) + [str(rng.random()) for _ in range(100)]) for i in range(800)]
    idf = nd.idf_weights(spark.createDataFrame([(t,) for t in texts], "text string"))
    common, rare = nd.shingles(pa.array(["the very same opening words"])), nd.shingles(pa.array(texts[1:2]))
    exact = lambda df: 1 + math.log(801 / (1 + df)) / math.log(802)
    assert abs(idf[nd.bucket_of(common[0])][0] - exact(267)) < 0.01
    assert abs(np.median(idf[nd.bucket_of(rare[0])]) - exact(1)) < 0.03


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 500)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components.connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), Scratch(spark, "t"), "c")
