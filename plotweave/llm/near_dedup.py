"""Near-duplicate classes: consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import Scratch, carried, restored, slices
from .components import connected

#: Words of a shingle and the least weighted Jaccard similarity of near duplicates.
SHINGLE, LEAST = 5, 0.8
#: Bands x rows samples a text: a pair at 0.8 shares a band with probability 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Document frequencies are counted in 2**IDF_BITS buckets of shingle hashes, at every size of input.
IDF_BITS = 20
#: A sample is searched among shingles whose least possible value is below this over the text's weight, then among all.
ENOUGH = 5.0
#: Texts and words of a block that is compared with another as a whole, and texts that meet their pivot in one group.
BLOCK_TEXTS, BLOCK_WORDS, STAR = 256, 1 << 18, 1024
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, their counts, and the texts' bounds in both.

    Words are runs of letters and digits (and all characters beyond ASCII) in lower case. A text of fewer than SHINGLE
    words, but not none, is one shingle; a text without words has none.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD, " ")
    lists = pc.ascii_split_whitespace(pc.utf8_trim(plain, " "))
    coded = lists.flatten().dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    rolled = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * _P + flat[k : k + len(rolled)]
    rolled = _mix(rolled)
    values, counts, bounds = [], [], [0]
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= SHINGLE:
            v, c = np.unique(rolled[a : b - SHINGLE + 1], return_counts=True)
        elif b == a or (b == a + 1 and flat[a] == 0):
            v, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in flat[a:b]:
                    h = h * _P + w
            v, c = _mix(np.array([h])), np.ones(1, np.int64)
        values.append(v)
        counts.append(c)
        bounds.append(bounds[-1] + len(v))
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64), np.asarray(bounds)


def bucket_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def idf_weights(docs: DataFrame) -> np.ndarray:
    """The weight of each bucket of shingle hashes: 1 + ln((1 + N) / (1 + df)) / ln(2 + N), between 1 and 2.

    A bucket counts, over all documents, the distinct shingles that fall into it. What the mean of all buckets would
    bring there by chance is subtracted, so that a rare shingle isn't taken for as common as its bucket's others; df is 1
    at least, and off by about the root of the mean load. Dividing by ln(2 + N) keeps a shingle that a third of the
    corpus holds within a factor of two of a rare one, so that the parts which near copies share don't vanish beside
    those in which they differ. Tasks send sums by bucket; 2**IDF_BITS rows at most reach the driver.
    """

    def count(batches):
        seen, n = np.zeros(1 << IDF_BITS, np.int32), 0
        for batch in batches:
            for part in slices(batch, "text"):
                values, _, _ = shingles(part["text"])
                np.add.at(seen, bucket_of(values), 1)
                n += part.num_rows
        at = np.flatnonzero(seen)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], names=["bucket", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    total = int(n[at < 0].sum())
    df = np.zeros(1 << IDF_BITS)
    df[at[at >= 0]] = n[at >= 0]
    df = np.clip(df - df.sum() / len(df), min(1, total), total)
    return (1 + np.log((1 + total) / (1 + df)) / np.log(2 + total)).astype(np.float32)


@functools.lru_cache(1)
def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers strictly between 0 and 1 from each hash."""
    return tuple((h.astype(np.float64) + 0.5) * 2.0**-32 for h in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)))


def _samples(mixed: np.ndarray, hi: np.ndarray, lo: np.ndarray, log_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of shingles by their hashes for a sample; (hi, lo) are the leading bits of the first two draws.

    r and c are drawn by way of e = c * u1, where r = -ln(u1 * u2): e is exponential, and c is e plus another exponential
    number. So c and r are independent and both Gamma(2, 1).
    """
    (more1, more2), (u3, b) = _halves(_mix(mixed + _P)), _halves(_mix(mixed + _M2))
    e = -np.log1p(-(hi + more1) * 2.0**-32)
    c = e - np.log(u3)
    r = np.maximum(-np.log(e / c * ((lo + more2) * 2.0**-32)), 1e-12)
    t = np.floor(log_s / r + b)
    return np.log(c) - r * (t - b + 1), t


def signatures(values: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of each text as 32-bit hashes of (shingle, t); texts without shingles get zeros.

    For weight S: r and c ~ Gamma(2, 1), b uniform, t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r; the
    shingle with the least a is the sample. Two texts draw the same (shingle, t) with a probability equal to their weighted
    Jaccard similarity. r, c and b come from hashes of shingle and sample.

    As ln y <= ln S, a is at least c * exp(-r) / S, and that at least the product of the first two draws over S. Only
    shingles where this bound is below ENOUGH over the text's weight are drawn in full; where no a turns out to be below it
    (exp(-ENOUGH) of the samples), all shingles of the text are. So the least a is always found.
    """
    out = np.zeros((len(bounds) - 1, SAMPLES), np.int32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    starts, sizes = bounds[full], np.diff(bounds)[full]
    weights = weights.astype(np.float64)
    log_s = np.log(weights)
    limit = ENOUGH / np.add.reduceat(weights, starts)
    log_limit = np.log(limit) - 1e-9
    most = np.minimum(np.repeat(limit, sizes) * weights * 2.0**64 * (1 + 1e-9), 1.8e19).astype(np.uint64)
    owners = np.repeat(np.arange(len(full)), sizes)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    mixed, hi, lo = (np.empty(len(values), np.uint64) for _ in range(3))
    for j, odd in enumerate(_multipliers()):
        np.multiply(values, odd, out=mixed)
        np.right_shift(mixed, half, out=hi)
        np.bitwise_xor(mixed, hi, out=mixed)
        np.multiply(mixed, _M1, out=mixed)
        np.right_shift(mixed, half, out=hi)
        np.bitwise_xor(mixed, hi, out=lo)
        np.bitwise_and(lo, low, out=lo)
        at = np.flatnonzero(np.multiply(hi, lo) <= most)
        owner = owners[at]
        log_a, t = _samples(mixed[at], hi[at], lo[at], log_s[at])
        least = np.full(len(full), np.inf)
        np.minimum.at(least, owner, log_a)
        again = np.flatnonzero(least >= log_limit)
        if len(again):
            keep = ~np.isin(owner, again)
            more = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in again])
            log_m, t_m = _samples(mixed[more], hi[more], lo[more], log_s[more])
            at, owner = np.append(at[keep], more), np.append(owner[keep], np.repeat(again, sizes[again]))
            log_a, t = np.append(log_a[keep], log_m), np.append(t[keep], t_m)
            np.minimum.at(least, owner, log_a)
        # the least of each text, and of equal ones the least hash
        near = log_a == least[owner]
        tag = np.full(len(full), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(tag, owner[near], _mix(mixed[at[near]] + t[near].astype(np.int64).view(np.uint64)) >> half)
        out[full, j] = tag.astype(np.uint32).view(np.int32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes in order, weights): sum of minima over sum of maxima."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


def _sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), size (its shingles, repeated ones included) and bands, null for a text without words."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("h1", "h2", "size")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, counts, bounds = shingles(part["text"])
                sig = signatures(values, counts * idf[bucket_of(values)], bounds)
                keys = np.zeros((len(sig), BANDS), np.uint64)
                for k in range(ROWS):
                    keys = _mix(keys * _P + sig[:, k::ROWS].view(np.uint32).astype(np.uint64))
                keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                none = np.diff(bounds) == 0
                lists = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], mask=np.append(none, False)), pa.array(m.ravel(), t))
                size = np.diff(np.append(0, np.cumsum(counts))[bounds])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h1"], part["h2"], pa.array(size), lists(keys, pa.int64())], names=schema.names)

    return _hashed(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text", F.octet_length("text"))})


def _own(texts: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes, in order, and weights of each text."""
    values, counts, bounds = shingles(texts)
    weights = counts * idf[bucket_of(values)]
    return [(values[a:b], weights[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _verify_stars(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, s: the pairs of a pivot a and a node b with their similarity, computed from whole texts (node, text).

    A pivot's text leads the group of its nodes' texts, so each text travels once for each pivot; a pivot with more than
    STAR nodes leads several groups.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    leads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("a").alias("node"))
    rows = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.col("b").alias("node")).union(leads)

    def run(batches):
        pivot = own = None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = []
                for a, g, node, text in zip(part["a"].to_pylist(), part["g"].to_pylist(), part["node"].to_pylist(), _own(part["text"], idf)):
                    if a == node:
                        pivot, own = (a, g), text
                    else:
                        if pivot != (a, g):
                            raise RuntimeError("a group without its pivot")
                        out.append((a, node, similarity(own, text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "s"])

    whole = rows.join(texts, "node").select("a", "g", "node", "text").repartition("a", "g").sortWithinPartitions("a", "g", F.col("node") != F.col("a"))
    return whole.mapInArrow(run, "a long, b long, s double")


def _vectors(texts: DataFrame) -> DataFrame:
    """node, v, c: shingle hashes in order and their counts, of texts (node, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, counts, bounds = shingles(part["text"])
                spans = list(zip(bounds[:-1], bounds[1:]))
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary())], names=["node", "v", "c"])

    return texts.mapInArrow(run, "node long, v binary, c binary")


def block_links(left: list[tuple], right: list[tuple] | None, idf: np.ndarray) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join the parts of the texts (node, part, hashes, counts) of two blocks, or of one.

    All pairs of texts in different parts count. What a pair shares is a product of matrices: a shingle that a text holds
    c times is c columns of weight idf, as the lesser of two counts is the number of columns that both have. Columns that
    one text alone has are left out, the others come in bounded slabs. Pairs near the threshold and above are computed
    again in full precision. Of links between two parts that links have joined already one is enough.
    """
    both = left + (right or [])
    if not both:
        return []
    sizes = np.array([len(t[2]) for t in both])
    values, counts = np.concatenate([t[2] for t in both]), np.concatenate([t[3] for t in both]).astype(np.int64)
    weight = idf[bucket_of(values)].astype(np.float32)
    total = np.bincount(np.repeat(np.arange(len(both)), sizes), weight.astype(np.float64) * counts, len(both))
    level = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = _mix(np.repeat(values, counts) + level.astype(np.uint64) * _P)
    owner, weight = np.repeat(np.repeat(np.arange(len(both)), sizes), counts), np.repeat(weight, counts)
    _, column, times = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    held = times[column] > 1
    column, owner, weight = number[column[held]], owner[held], weight[held]
    order = np.argsort(column, kind="stable")
    column, owner, weight = column[order], owner[order], weight[order]
    first, n = (0, len(left)) if right else (0, len(both))
    shared = np.zeros((n, len(both) - n if right else n), np.float32)
    slab = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
        a, b = np.searchsorted(column, (lo, lo + slab))
        has = np.zeros((len(both), slab), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        weights = np.zeros(slab, np.float32)
        weights[column[a:b] - lo] = weight[a:b]
        shared += (has[:n] * weights) @ (has[n:] if right else has).T
    offset = n if right else 0
    part = np.array([t[1] for t in both])
    ok = shared >= (LEAST - 1e-3) * (total[:n, None] + total[None, offset:] - shared)
    ok &= part[:n, None] != part[None, offset:]
    if not right:
        ok = np.triu(ok, 1)
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    out = []
    own = lambda t: (t[2], t[3] * idf[bucket_of(t[2])])
    for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
        x, y = both[i], both[offset + j]
        p, q = find(x[1]), find(y[1])
        if p != q and (s := similarity(own(x), own(y))) >= LEAST:
            root[p] = q
            out.append((x[0], y[0], s))
    return out


def _open_links(component: DataFrame, vectors: DataFrame, idf: np.ndarray, scratch: Scratch) -> DataFrame:
    """a, b, s: links of texts that share a bucket and are in different parts, as many as join the parts; component: bucket, node, size, part.

    A bucket's texts are dealt to blocks of bounded size, those of its largest part apart, as these need not meet each
    other. Every two blocks that hold different parts are one group; no pair of texts is ever a row. The table of buckets
    is written, so that the join has two plain exchanges and the planner may split a hot bucket.
    """
    by_part = component.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    most = F.max(F.struct("n", "part", "words"))
    buckets = by_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("words").alias("words"), most.alias("m")).where("parts > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(w / BLOCK_WORDS), F.lit(1)).cast("int")
    buckets = buckets.select("bucket", F.col("m.part").alias("major"), blocks(F.col("m.n"), F.col("m.words")).alias("large"), blocks(F.col("n") - F.col("m.n"), F.col("words") - F.col("m.words")).alias("small"))
    dealt = component.join(scratch.cut(buckets, "buckets"), "bucket").withColumn("own", F.expr("IF(part = major, small + pmod(xxhash64(node), large), pmod(xxhash64(node), small))").cast("int"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, IF(part = major, small, small + large) - 1)")))
    rows = met.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part").join(vectors, "node")

    def run(batches):
        key, left, right = None, [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "s"])
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["bucket"], r["lo"], r["hi"])
                if now != key:
                    if left and (right or key[1] == key[2]):
                        found = block_links(left, right or None, idf)
                        yield out()
                    key, left, right = now, [], []
                (left if r["own"] == r["lo"] else right).append((r["node"], r["part"], np.frombuffer(r["v"], np.uint64), np.frombuffer(r["c"], np.int32)))
        if left and (right or key[1] == key[2]):
            found = block_links(left, right or None, idf)
            yield out()

    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(run, "a long, b long, s double")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, class_id, lead1, lead2, link_id and link_similarity for every row; class_id is the least doc_id of the row's class.

    Equal texts are one node. Texts that share a band meet in its bucket, and each is tested against the bucket's pivot,
    the text with most bucket mates; so a bucket of n texts gives n - 1 pairs. What such stars leave open are texts of one
    bucket in different components: all these pairs are compared, block against block. Links are verified by weighted
    Jaccard similarity over whole texts; classes are the components of the links. link_id is the least doc_id of the most
    similar text that was found linked, null where there is none.

    Null and empty texts, and texts without words, are near duplicates of equal texts only. Repeated rows share a class.
    (lead1, lead2) are the hashes of the class's least doc_id's text. A null doc_id comes before all others. Very long
    texts are whole nodes; an empty table gives an empty one; other columns are dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select("doc_id", "text")
    idf = idf_weights(base)
    signed = scratch.cut(_sign(base, idf), "signed")
    lead = F.min(F.struct("doc_id", "h1", "h2")).alias("lead")
    nodes = signed.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id"))).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = scratch.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("first.doc_id").alias("doc_id"), "size", "bands"), "nodes")

    entries = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes = scratch.cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = scratch.cut(entries.join(sizes, "bucket"), "shared")
    mates = shared.groupBy("node").agg(F.sum("n").alias("mates"))
    ranked = shared.join(mates, "node")
    pivots = scratch.cut(ranked.groupBy("bucket").agg(F.max(F.struct("mates", "node"))["node"].alias("pivot")), "pivots")
    members = scratch.cut(shared.join(pivots, "bucket").select("bucket", "node", "size", "pivot"), "members")
    pairs = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()

    wanted = members.select("node").distinct().join(nodes.select("node", "h1", "h2", "doc_id"), "node")
    texts = _hashed(base).join(wanted.select("node", F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("doc_id").alias("_id")), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    texts = scratch.cut(_one_each(texts), "texts")
    tested = scratch.cut(_verify_stars(pairs, texts, idf).where(f"s >= {LEAST}"), "tested")
    stars = scratch.cut(connected(tested.select("a", "b"), scratch, "stars"), "roots")

    component = scratch.cut(members.join(stars, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("part")), "component")
    several = scratch.cut(component.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("bucket"), "several")
    rest = scratch.cut(component.join(several, "bucket"), "rest")
    vectors = scratch.cut(_vectors(texts.join(rest.select("node").distinct(), "node").select("node", "text")), "vectors")
    found = scratch.cut(_open_links(rest, vectors, idf, scratch), "found")
    roots = connected(stars.select(F.col("root").alias("a"), F.col("node").alias("b")).union(found.select("a", "b")), scratch, "all") if found.take(1) else stars

    ends = tested.union(found)
    best = ends.union(ends.select("b", "a", "s")).groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("s", "b")).alias("link"), F.max("s").alias("link_similarity"))
    links = best.join(nodes.select(F.col("node").alias("link"), F.col("doc_id").alias("link_id")), "link").select("node", "link_id", "link_similarity")
    placed = nodes.select("node", "h1", "h2", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leads = scratch.cut(placed.groupBy("root").agg(lead), "leads")
    classes = placed.join(leads, "root").join(links, "node", "left").select("h1", "h2", F.col("lead.doc_id").alias("class_id"), F.col("lead.h1").alias("lead1"), F.col("lead.h2").alias("lead2"), "link_id", "link_similarity")
    classes = scratch.cut(classes, "classes")
    scratch.keep("signed", "classes")
    return signed.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"])


def _one_each(texts: DataFrame) -> DataFrame:
    """The rows of a task with each node once: the join on a text's hashes brings its repeated rows together. A node that several tasks still hand out is compared anew, no more."""

    def run(batches):
        seen = set()
        for batch in batches:
            yield batch.filter(pa.array([n not in seen and not seen.add(n) for n in batch["node"].to_pylist()], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def near_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", F.expr("doc_id <=> class_id AND h1 = lead1 AND h2 = lead2").alias("stays"), "link_id", "link_similarity")


def near_stage(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that of its least doc_id, with its own columns; of repeated rows one stays."""
    stay = near_duplicates(docs).where("doc_id <=> class_id AND h1 = lead1 AND h2 = lead2").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.col("h1").alias("_1"), F.col("h2").alias("_2")).distinct()
    keyed = carried(docs).select("doc_id", "text", "row", F.coalesce("doc_id", F.lit(-(2**63))).alias("_k"), F.xxhash64("text").alias("_1"), F.xxhash64(F.lit(1), "text", F.octet_length("text")).alias("_2"))
    return restored(keyed.join(stay, ["_k", "_1", "_2"]).dropDuplicates(["_k", "_1", "_2"]), docs.columns)
