"""Passages that start in an earlier document too, by compressed indexes of shards that documents are streamed against."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._shared import Scratch, slices
from .fm_index import FMIndex
from .suffix_dedup import Rule, _occurrences, spans_of, units

#: 50 words are a passage; the least hash of its 20-word substrings says which shard it belongs to.
PASSAGES = Rule(length=50, words=True, gram=20, cell=1, many=256)
#: Words of an index.
INDEX_WORDS = 1 << 18

_KEY = ["h", "c1", "c2"]
#: A place of a context: of its least document (to be indexed) or of its greatest (to be streamed).
_PLACE = [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("data", pa.binary())]
_ORIGIN = [("h0", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("s", pa.int32())]
_SPARK = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType()}
_RUN_PA = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("id", pa.int64())]))
_RUN = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("id", T.LongType())]))
_ANSWER = T.StructType([*(T.StructField(c, T.LongType()) for c in _KEY), T.StructField("runs", _RUN)])
#: A null doc_id comes before all others.
NONE = -(1 << 63)


def _schema(columns) -> T.StructType:
    return T.StructType([T.StructField(n, _SPARK[t]) for n, t in columns])


def _batch(columns, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def earliest_starts(contexts: list[tuple[np.ndarray, np.ndarray, int, int]], length: int) -> list[np.ndarray]:
    """For each context (words of its indexed and of its streamed place, document, starts) the least document in which each start's passage starts.

    The indexed places make one FM-index; the streamed ones are searched backward, and where the matching statistics reach
    ``length`` the interval of that many words holds all places of the passage. A start without such a match gets the
    greatest number.
    """
    kinds = np.unique(np.concatenate([a for a, *_ in contexts] or [np.zeros(0, np.uint64)]))
    local = lambda words: np.where(kinds[np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)] == words, np.searchsorted(kinds, words) + 1, 0)
    index = FMIndex([local(a) for a, *_ in contexts], length)
    least = index.least_owner(np.array([doc for _, _, doc, _ in contexts], np.int64))
    out = []
    for (_, _, _, n), (found, row) in zip(contexts, index.matching_statistics([local(b) for _, b, *_ in contexts])):
        out.append(np.where(found[:n] >= length, least[row[:n]], np.iinfo(np.int64).max))
    return out


def _answers(places: DataFrame, rule: Rule) -> DataFrame:
    """_ANSWER: of contexts in partitions by anchor, in order of key and id, runs of starts and the least document of each, below the context's greatest."""

    def run(batches):
        block, words, now = [], 0, None

        def out():
            rows = []
            for c, ids in zip(block, earliest_starts([(c["one"], c["two"], c["id"], c["n"]) for c in block], rule.length)):
                edge = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
                runs = [{"lo": a, "hi": b, "id": i} for a, b, i in zip(edge.tolist(), edge[1:].tolist(), ids[edge[:-1]].tolist()) if i < c["last"]]
                if runs:
                    rows.append((*c["key"], runs))
            return _batch([*_PLACE[:3], ("runs", _RUN_PA)], rows)

        for batch in batches:
            for part in slices(batch, "data"):
                for r in part.to_pylist():
                    key, data = (r["h"], r["c1"], r["c2"]), np.frombuffer(r["data"], np.uint64)
                    if block and block[-1]["key"] == key:
                        block[-1] |= {"two": data, "last": r["id"]}
                        continue
                    if key[0] != now and words >= INDEX_WORDS:
                        yield out()
                        block, words = [], 0
                    now = key[0]
                    words += len(data)
                    block.append({"key": key, "one": data, "two": data, "id": r["id"], "last": r["id"], "n": r["n"]})
        if block:
            yield out()

    return places.mapInArrow(run, _ANSWER)


def _ends(rows: DataFrame, place: list[str]) -> DataFrame:
    """Of each context one row for the place of its least document, and one for that of its greatest where that is another."""
    two = rows.groupBy(*_KEY).agg(F.min(F.struct(*place)).alias("one"), F.max(F.struct(*place)).alias("two"))
    first = F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p")))
    both = F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p")), F.struct(F.lit(1).alias("copy"), F.col("two").alias("p")))
    return two.select(*_KEY, F.inline(F.when(F.col(f"one.{place[0]}") < F.col(f"two.{place[0]}"), both).otherwise(first))).select(*_KEY, "copy", "p.*")


def _shared(ends: DataFrame, scratch: Scratch, name: str, doc: str) -> DataFrame:
    """Rows of anchors that two documents hold, with ``kinds``, the anchor's contexts. All else starts in one document alone, and leaves."""
    per = ends.groupBy("h").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.count_if(F.col("copy") == 0).alias("kinds")).where("a < b").select("h", "kinds")
    return ends.join(scratch.cut(per, name), "h")


def _words_of(base: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """_PLACE and kinds: the words of each wanted place, cut from its document. Of repeated rows a task reads one."""
    cut = F.struct("h", "c1", "c2", "n", "off", "at", "kinds")
    lists = wanted.groupBy("dk", "th").agg(F.collect_list(cut).alias("cuts"))
    columns = [*_PLACE, ("kinds", pa.int64())]

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                fresh = [k not in seen and not seen.add(k) for k in zip(part["dk"].to_pylist(), part["th"].to_pylist())]
                part = part.filter(pa.array(fresh))
                rows = []
                for doc, data, cuts in zip(part["dk"].to_pylist(), units(part["text"], rule), part["cuts"].to_pylist()):
                    for c in cuts:
                        rows.append((c["h"], c["c1"], c["c2"], doc, c["n"], c["off"], data[c["at"] : c["at"] + c["n"] + rule.length - 1].tobytes(), c["kinds"]))
                        if len(rows) >= 4096:
                            yield _batch(columns, rows)
                            rows = []
                yield _batch(columns, rows)

    return base.join(lists, ["dk", "th"]).select("dk", "th", "text", "cuts").mapInArrow(run, _schema(columns))


def _parts(places: DataFrame, rule: Rule, step: int) -> DataFrame:
    """_ORIGIN and _PLACE: contexts cut where the distance of a start from its anchor passes a multiple of ``step``.

    All passages of a part hold the same substring of length - step + 1 words, under whose hash the part is filed; so
    equal passages still meet, and passages that only share the anchor no longer do.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "data", 1 << 18):
                rows = []
                for r in part.to_pylist():
                    view, n, off = memoryview(r["data"]), r["n"], r["off"]
                    for k in range((off - n + 1) // step, off // step + 1):
                        a, b = max(0, off - (k + 1) * step + 1), min(n, off - k * step + 1)
                        h = xxhash.xxh3_64_intdigest(view[8 * (off - k * step) : 8 * (off - (k + 1) * step + 1 + rule.length)], step << 20 | k) - (1 << 63)
                        data = bytes(view[8 * a : 8 * (b + rule.length - 1)])
                        c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist()
                        rows.append((r["h"], r["c1"], r["c2"], a, h, c1, c2, r["id"], b - a, off - a, data))
                yield _batch([*_ORIGIN, *_PLACE], rows)

    return places.mapInArrow(run, _schema([*_ORIGIN, *_PLACE]))


def _all_answers(places: DataFrame, scratch: Scratch, rule: Rule, step: int, level: int = 0) -> DataFrame:
    """_ANSWER of all contexts, one row or more for each that has any.

    Anchors of ``rule.many`` contexts at most are whole in one index. Contexts of the others are parted by the distance
    from the anchor, down to single passages where need be: equal parts become one, with its least and greatest document,
    and what is in one document alone leaves. No task holds an anchor's contexts beyond ``rule.many``.
    """
    columns = [n for n, _ in _PLACE]
    out = _answers(places.where(f"kinds <= {rule.many}").select(*columns).repartition("h").sortWithinPartitions(*_KEY, "id"), rule)
    crowded = places.where(f"kinds > {rule.many}")
    if not crowded.take(1):
        return out
    step = max(1, (step + 3) // 4)
    parts = scratch.cut(_parts(crowded.select(*columns), rule, step), f"parts{level}")
    ends = scratch.cut(_ends(parts, ["id", "n", "off", "data"]), f"ends{level}")
    # a part of one start is a passage, and all its places are one context
    inner = scratch.cut(_all_answers(_shared(ends, scratch, f"per{level}", "id"), scratch, rule, step, level + 1), f"inner{level}")
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("s")).alias("lo"), (r["hi"] + F.col("s")).alias("hi"), r["id"].alias("id")))
    # both places of a context have the same parts: the least of them is enough
    origins = parts.groupBy("h0", "d1", "d2", "s", *_KEY).agg(F.min("id").alias("id")).drop("id")
    placed = origins.join(inner, _KEY).select(F.col("h0").alias("h"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), moved.alias("runs"))
    return out.union(placed)


def earlier_passages(base: DataFrame, scratch: Scratch, rule: Rule = PASSAGES) -> DataFrame:
    """dk, th and ``found``, an array of (at, runs): the starts at + lo to at + hi - 1 of passages that start in an earlier document too.

    1. Each start is filed under its passage's anchor, the least hash of its 20-word substrings; a run of starts with one
       anchor is a context. Equal passages share the anchor, so each document goes to the few shards that can hold its
       passages, and not to all. Contexts are counted: those of anchors that one document alone holds leave.
    2. A shard is a range of anchors. The contexts of the least documents are indexed, those of the greatest are streamed
       against the index; that decides every start of a context at once, as the index knows the least document of each
       interval. Only two places of equal contexts are read: a third can't be earlier than the least.
    3. Every document takes those starts of its contexts whose least document is earlier than itself.
    """
    every = scratch.cut(_occurrences(base, rule), "every")
    ends = scratch.cut(_ends(every, ["dk", "th", "at", "n", "off"]), "ends")
    wanted = scratch.cut(_shared(ends, scratch, "per", "dk"), "wanted")
    scratch.drop("ends", "per")
    places = scratch.cut(_words_of(base, wanted, rule), "places")
    scratch.drop("wanted")
    answers = scratch.cut(_all_answers(places, scratch, rule, rule.width), "answers")
    scratch.keep("every", "answers")
    earlier = F.transform(F.filter("runs", lambda r: r["id"] < F.col("dk")), lambda r: F.struct(r["lo"], r["hi"]))
    hits = every.select("dk", "th", "at", *_KEY).join(answers, _KEY).select("dk", "th", F.struct("at", earlier.alias("runs")).alias("hit")).where("size(hit.runs) > 0")
    found = scratch.cut(hits.groupBy("dk", "th").agg(F.collect_set("hit").alias("found")), "found")
    scratch.keep("found")
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("dk"), text.alias("text"), F.xxhash64(text).alias("th"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_passages(docs: DataFrame, rule: Rule = PASSAGES) -> DataFrame:
    """doc_id, n_words, spans (start and end of removed words, maximal and in order) and kept (the other words, joined by one space) for every row.

    A word goes if a passage of ``rule.length`` consecutive words that covers it also starts in a document with a smaller
    doc_id; passages are judged on the input. doc_id is a whole number, a null one comes before all others; rows with the
    same doc_id don't take from each other; a null text has no words; shorter texts stay whole; very long texts are cut
    into overlapping segments; an empty table gives an empty one; other columns, whatever their names, are dropped.
    Words are compared as 64-bit hashes, and places of equal contexts are known by 128-bit hashes.
    """
    base = _keyed(docs)
    found = earlier_passages(base, Scratch(docs.sparkSession, "passages"), rule)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                spans = spans_of(part["found"], rule.length)
                at, edges = spans.offsets.to_pylist(), np.stack([spans.values.field("start"), spans.values.field("end")], 1).ravel().tolist()
                kept, counts = [], []
                for data, a, b in zip(part["text"].cast(pa.binary()).to_pylist(), at[:-1], at[1:]):
                    words = data.split()  # parts at exactly space and the codes 9 to 13
                    counts.append(len(words))
                    own = [0, *edges[2 * a : 2 * b], len(words)]
                    kept.append(b" ".join([w for x, y in zip(own[::2], own[1::2]) for w in words[x:y]] if b > a else words))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64()), spans, pa.array(kept, pa.binary())], names=schema.names)

    return base.join(found, ["dk", "th"], "left").select("doc_id", "text", "found").mapInArrow(run, schema)


def _total(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def passages_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_passages(docs).select("doc_id", "n_words", _total("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
