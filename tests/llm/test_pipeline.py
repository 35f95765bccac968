"""The pipeline's stages in turn against brute force on a small table."""

import random
import zlib

import pyarrow as pa
import zstandard

from plotweave.llm import near_dedup as nd, packing, quality

from .test_corpus import brute_hits, brute_lines
from .test_near import brute


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(2000)]
    say = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    items = [(i, say(2)) for i in range(3)]
    texts = [say(rng.randint(2, 40)) for _ in range(30)]
    texts += [texts[5], texts[6], texts[7].replace("a", "b", 1), texts[9] + "\n" + say(6), say(5) + "\n" + items[1][1] + "\n" + say(4), "the same words " * 90, None, "", say(20) + "\n" + "\n".join(texts[12].split("\n")[:4])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    squeeze = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = []
    for i, t in enumerate(texts):
        m = dict(zip(quality.MEASURES, quality.measure((t or "").encode(), squeeze)))
        _, low, high = max(b for b in quality.WHOLE_BANDS if b[0] <= m["n_bytes"])
        if m["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"] and low <= m["n_zstd_bytes"] / m["n_bytes"] <= high and m["n_bad_chunks"] <= 0.5 * m["n_chunks"]:
            kept.append((i, t))
    lines = brute_lines(kept)
    kept = [(i, lines[i][2]) for i, _ in kept if lines[i][1] == 0 or lines[i][1] < lines[i][0]]
    idf = nd.idf_weights(spark.createDataFrame(kept, "doc_id long, text string"))
    roots = brute([t for _, t in kept], idf)[0]
    kept = [kept[i] for i in sorted(set(roots))]
    hits = brute_hits(kept, items)
    kept = [(i, t) for i, t in kept if not hits[i][4]]
    words_of = packing.WordTokenizer(packing.default_tokenizer())
    ids, bounds = words_of.encode(pa.array([t for _, t in kept]))
    assert {r.doc_id for r in got} == {i for i, _ in kept} and 20 < len(kept) < len(texts)
    for (i, _), a, b in zip(kept, bounds, bounds[1:]):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == b - a
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[a + r.start : a + r.start + r.length].astype("<u4").tobytes())
