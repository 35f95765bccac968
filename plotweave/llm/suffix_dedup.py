"""Strings that start at two places or more, by merged Burrows-Wheeler transforms of candidate contexts."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import Scratch, slices
from .bwt import repeated_intervals

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


@dataclasses.dataclass(frozen=True)
class Rule:
    """What counts as repeated, and the sizes by which the work is cut. Results depend on ``length`` and ``words`` alone."""

    #: Units of a string that counts as repeated; units are bytes, or words where ``words``.
    length: int = 400
    words: bool = False
    #: A string is filed under the leftmost least hash of its ``gram``-unit substrings.
    gram: int = 200
    #: Units of a symbol of the transforms.
    cell: int = 16
    #: Symbols of a block that one merge takes, and distinct contexts of an anchor that stay together.
    block: int = 48_000
    many: int = 128
    #: Texts are cut into runs of so many starting points (below 2**20 - length).
    segment: int = 1 << 19

    @property
    def width(self) -> int:
        """Distances that an anchor may have from the start of its string."""
        return self.length - self.gram + 1

    @property
    def unit(self) -> int:
        """Bytes of a unit."""
        return 8 if self.words else 1

    @property
    def depth(self) -> int:
        """Whole symbols in any string, once symbols are aligned with its anchor."""
        return self.length // self.cell - 1 if self.cell > 1 else self.length


BYTES = Rule()
#: Passages: 50 consecutive words.
WORDS = Rule(length=50, words=True, gram=10, cell=5)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < n:
        n = 1 << max(16, int(n).bit_length())
        for name, base in (("n", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(base))]))
    return _powers["n"], _powers["inverse"]


def _gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A mixed polynomial hash of each substring of ``length`` units."""
    n = len(data)
    power, inverse = _power(n + 1)
    before = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=before[1:])
    return _mixed((before[length:] - before[:-length]) * inverse[: n - length + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, rule: Rule = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first start, starts, and place of the anchor behind the first start, of runs of strings with the same anchor.

    Which substring is a string's anchor depends on its own units alone, so equal strings have equal anchors at equal
    distances from their starts, and every starting point is in exactly one run of ``rule.width`` starts at most.
    """
    found = []
    for base in range(0, max(0, len(data) - rule.length + 1), rule.segment):
        part = data[base : base + rule.segment + rule.length - 1]
        full = _gram_hashes(part, rule.gram)
        # the place in the low bits makes the leftmost of equal hashes the least
        least = (full & ~_LOW) | np.arange(len(full), dtype=np.uint64)
        n, span = len(part) - rule.length + 1, 1
        while span * 2 <= rule.width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        at = (np.minimum(least[:n], least[rule.width - span : rule.width - span + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((full[at[first]].view(np.int64), base + first, np.diff(first, append=n), at[first] - first))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def units(texts: pa.Array, rule: Rule) -> list[np.ndarray]:
    """The units of each text: its UTF-8 bytes, or 64-bit hashes of its words (runs of all but space and the codes 9 to 13). Null has none."""
    data = [np.frombuffer(t.as_py() or b"", np.uint8) for t in texts.cast(pa.binary())]
    if not rule.words:
        return data
    flat = np.concatenate([x for d in data for x in (d, np.full(1, 32, np.uint8))] or [np.zeros(0, np.uint8)])
    at, hashed = _words(flat)
    return np.split(hashed, np.searchsorted(at, np.cumsum([len(d) + 1 for d in data])[:-1])) if data else []


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of words: hashed by eight bytes at a time, and long words as a whole."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(inside))
    at, left = edge[::2], edge[1::2] - edge[::2]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    out = left.astype(np.uint64)
    live = np.flatnonzero(left <= 32)
    for k in range(0, 32, 8):
        rest = left[live] - k
        live, rest = live[rest > 0], np.minimum(rest[rest > 0], 8)
        kept = eights[at[live] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest) * 8).astype(np.uint64))
        out[live] = _mixed(out[live] * np.uint64(_BASE) + kept)
    for i in np.flatnonzero(left > 32).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + left[i]])
    return at, out


_OCCURRENCE = [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("off", pa.int32())]
_SPARK = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType()}
_PLACE = ("dk", "th", "at", "n", "off")


def _fields(columns) -> list[T.StructField]:
    return [T.StructField(n, _SPARK[t]) for n, t in columns]


def _occurrences(docs: DataFrame, rule: Rule) -> DataFrame:
    """dk, th and a row for each run of ``anchors``: anchor, 128-bit hash of its context, first start, starts, offset."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                runs, contexts = [], []
                for data in units(part["text"], rule):
                    runs.append(anchors(data, rule))
                    view = memoryview(data)
                    contexts += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(runs[-1][1].tolist(), (runs[-1][1] + runs[-1][2] + rule.length - 1).tolist())]
                h, at, n, off = (np.concatenate(c) for c in zip(*runs))
                taken = np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs])
                c = np.frombuffer(b"".join(contexts), np.int64).reshape(-1, 2)
                columns = (h, c[:, 0], c[:, 1], at, n, off)
                yield pa.RecordBatch.from_arrays([part["dk"].take(taken), part["th"].take(taken), *(pa.array(c, t) for c, (_, t) in zip(columns, _OCCURRENCE))], names=["dk", "th", *(n for n, _ in _OCCURRENCE)])

    return docs.mapInArrow(run, T.StructType([T.StructField("dk", T.LongType()), T.StructField("th", T.LongType()), *_fields(_OCCURRENCE)]))


def repeated_starts(contexts: list[tuple[np.ndarray, int, int]], rule: Rule = BYTES) -> list[np.ndarray]:
    """For each context (units, offset of its anchor, starts) which of its starts have a string that occurs twice or more here.

    Symbols are runs of ``rule.cell`` units aligned with the anchor. A string has ``rule.depth`` whole symbols, so equal
    strings lie in one interval of the merged transforms whose common prefix is that many symbols; the units of the
    string before and behind them are then compared as they are.
    """
    out = [np.zeros(n, bool) for _, _, n in contexts]
    cell, depth = rule.cell, rule.depth
    base, cells, held = [], [], 0
    for data, off, _ in contexts:
        skip = off % cell
        base.append(held + skip)
        cells.append((len(data) - skip) // cell)
        held += len(data)
    kind = np.uint64 if rule.words else np.uint8
    flat = np.concatenate([*(c[0] for c in contexts), np.zeros(rule.length, kind)]).astype(kind)
    taken = np.concatenate([np.arange(m) * cell + b for m, b in zip(cells, base)]) if cells else np.zeros(0, np.int64)
    if not len(taken):
        return out
    words = np.ascontiguousarray(flat[taken[:, None] + np.arange(cell)]).view(np.uint64)
    order = np.lexsort(words.T[::-1])
    line = words[order]
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(np.concatenate([[1], (line[1:] != line[:-1]).any(1)]))
    bounds = np.concatenate([[0], np.cumsum(cells)]).astype(np.int64)
    interval, owner, place = repeated_intervals([symbol[a:b] for a, b in zip(bounds, bounds[1:])], depth)
    if not len(interval):
        return out
    begins = np.concatenate([[0], np.cumsum([len(c[0]) for c in contexts])])[:-1]
    firsts = np.concatenate([[0], np.cumsum([c[2] for c in contexts])])
    core = np.asarray(base)[owner] + place * cell
    inner = core - begins[owner]
    # leads, the units of a string before its first whole symbol, with which its start is one of the context's
    low, high = np.maximum(0, inner - np.diff(firsts)[owner] + 1), np.minimum(cell - 1, inner)
    some = low <= high
    interval, owner, core, inner, low, high = (x[some] for x in (interval, owner, core, inner, low, high))
    rim, edge = rule.length - depth * cell, np.arange(cell)
    before = np.where(edge >= cell - high[:, None], flat[core[:, None] - cell + edge], 0).astype(kind)
    behind = np.where(edge[:rim] < rim - low[:, None], flat[core[:, None] + depth * cell + edge[:rim]], 0).astype(kind)
    columns = [interval, low, high, *(np.ascontiguousarray(x).view(np.uint64).T for x in (before, behind) if rim)]
    first, group = _groups(np.vstack([np.asarray(c).view(np.uint64) for c in columns]))
    many = np.bincount(group) > 1
    # what surrounds the symbols is the same at two places: their strings are repeated with every lead
    edges = np.zeros(firsts[-1] + 1, np.int64)
    at = firsts[owner] + inner
    same = many[group]
    np.add.at(edges, (at - high)[same], 1)
    np.add.at(edges, (at - low)[same] + 1, -1)
    flags = np.cumsum(edges)[:-1] > 0
    # of unequal surroundings, one each, every lead is compared by itself
    mixed = first[np.bincount(interval[first], minlength=int(interval.max(initial=0)) + 1)[interval[first]] > 1]
    if len(mixed):
        counts = (high - low + 1)[mixed]
        row = np.repeat(mixed, counts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
        columns = [interval[row], k]
        if rim:
            where = np.where(edge < k[:, None], core[row][:, None] - k[:, None] + edge, core[row][:, None] + depth * cell + edge - k[:, None])
            columns.append(np.ascontiguousarray(flat[where]).view(np.uint64).T)
        _, group = _groups(np.vstack([np.asarray(c).view(np.uint64) for c in columns]))
        twice = (np.bincount(group) > 1)[group]
        flags[(at[row] - k)[twice]] = True
    return np.split(flags, firsts[1:-1])


def _groups(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first member of each group of equal columns, and the group of each column."""
    order = np.lexsort(columns)
    line = columns[:, order]
    new = np.concatenate([[True], (line[:, 1:] != line[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_KEY = ["h", "c1", "c2"]
#: A context's bytes: one row for each of the two places at most that are read of it.
_CONTEXT = [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("copy", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("data", pa.binary())]
_RUNS_PA = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_RUNS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
_RANGES = T.StructType([*(T.StructField(c, T.LongType()) for c in _KEY), T.StructField("runs", _RUNS)])


def _two_places(rows: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """One row for each key and copy: the least and, where there are more, the greatest place, with their number."""
    one = rows.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct(*place)).alias("one"), F.max(F.struct(*place)).alias("two"))
    copies = F.when(F.col("times") > 1, F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p")), F.struct(F.lit(1).alias("copy"), F.col("two").alias("p")))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("one").alias("p"))))
    return one.select(*key, "times", F.inline(copies)).select(*key, "times", "copy", "p.*")


def _unsettled(distinct: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of keys that occur twice or share their anchor with another key, with ``kinds``, the anchor's distinct keys. The rest is unique and leaves.

    The count by anchor is written, so that the join has two plain exchanges and the planner may split a hot anchor.
    """
    per = scratch.cut(distinct.where("copy = 0").groupBy("h").agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 OR most > 1").select("h", "kinds"), name)
    return distinct.join(per, "h").where("kinds > 1 OR times > 1")


def _fetch(base: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """The units of contexts, cut from the documents that hold them: _CONTEXT. Of repeated rows a task reads one."""
    lists = wanted.groupBy("dk", "th").agg(F.collect_list(F.struct("at", *(n for n, _ in _CONTEXT[:-1]))).alias("cuts"))

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                fresh = [k not in seen and not seen.add(k) for k in zip(part["dk"].to_pylist(), part["th"].to_pylist())]
                part = part.filter(pa.array(fresh))
                for data, cuts in zip(units(part["text"], rule), part["cuts"].to_pylist()):
                    rows += [cut | {"data": data[cut["at"] : cut["at"] + cut["n"] + rule.length - 1].tobytes()} for cut in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _CONTEXT], names=[n for n, _ in _CONTEXT])

    return base.join(lists, ["dk", "th"]).select("dk", "th", "text", "cuts").mapInArrow(run, T.StructType(_fields(_CONTEXT)))


def _merge_blocks(contexts: DataFrame, rule: Rule) -> DataFrame:
    """_RANGES of contexts that lie in partitions by anchor, in order of it: whole anchors fill a block, and each block is merged."""
    kind = np.uint64 if rule.words else np.uint8

    def run(batches):
        block, symbols, now = [], 0, None

        def out():
            flags = repeated_starts([(np.frombuffer(r["data"], kind), r["off"], r["n"]) for r in block], rule)
            found = [(r, _runs(f)) for r, f in zip(block, flags) if not r["copy"] and f.any()]
            return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r, _ in found], pa.int64()) for c in _KEY), pa.array([[{"lo": a, "hi": b} for a, b in runs] for _, runs in found], _RUNS_PA)], names=[*_KEY, "runs"])

        for batch in batches:
            for part in slices(batch, "data"):
                for r in part.to_pylist():
                    if r["h"] != now and symbols >= rule.block:
                        yield out()
                        block, symbols = [], 0
                    now = r["h"]
                    block.append(r)
                    symbols += len(r["data"]) // (rule.cell * rule.unit) + 1
        if block:
            yield out()

    return contexts.mapInArrow(run, _RANGES)


#: The key of the context that a part was cut from, the part's first start in it, the part's own key and context.
_PART = [("h0", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("copy0", pa.int32()), ("s", pa.int32()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("data", pa.binary())]


def _part(contexts: DataFrame, rule: Rule, step: int) -> DataFrame:
    """_PART: contexts cut where the distance of a start from its anchor passes a multiple of ``step``.

    All strings of a part hold the same substring of length - step + 1 units, under whose hash the part is filed.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "data", 1 << 19):
                cols = [[] for _ in _PART]
                for r in part.to_pylist():
                    view, n, off = memoryview(r["data"]), r["n"], r["off"]
                    cut = lambda a, b: view[a * rule.unit : b * rule.unit]
                    for k in range((off - n + 1) // step, off // step + 1):
                        a, b = max(0, off - (k + 1) * step + 1), min(n, off - k * step + 1)
                        h = xxhash.xxh3_64_intdigest(cut(off - k * step, off - (k + 1) * step + 1 + rule.length), step << 20 | k)
                        data = cut(a, b + rule.length - 1)
                        c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist()
                        for col, v in zip(cols, (r["h"], r["c1"], r["c2"], r["copy"], a, h - (1 << 63), c1, c2, b - a, off - a, bytes(data))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _PART)], names=[n for n, _ in _PART])

    return contexts.mapInArrow(run, T.StructType(_fields(_PART)))


#: Adjacent and overlapping runs as one.
_JOINED = "aggregate(array_sort(runs), cast(array() AS array<struct<lo:int,hi:int>>), (a, r) -> IF(size(a) > 0 AND element_at(a, -1).hi >= r.lo, concat(slice(a, 1, size(a) - 1), array(named_struct('lo', element_at(a, -1).lo, 'hi', greatest(element_at(a, -1).hi, r.hi)))), concat(a, array(r))))"


def _ranges(contexts: DataFrame, scratch: Scratch, rule: Rule, step: int, level: int = 0) -> DataFrame:
    """_RANGES of _CONTEXT with ``kinds``, the distinct contexts of the anchor; one row for each context that has any.

    Anchors that ``rule.many`` contexts share at most go to blocks. Contexts of the others are parted by the distance from
    the anchor and filed under the longer substring that all strings of a part hold; equal parts become one, with two
    places, and parts that are alone leave. So no task ever holds an anchor's contexts beyond ``rule.many``, and the
    merged transforms decide all the same; with steps of one start a part is a string, and equal ones are one row.
    """
    columns = [n for n, _ in _CONTEXT]
    out = _merge_blocks(contexts.where(f"kinds <= {rule.many}").select(*columns).repartition("h").sortWithinPartitions("h"), rule)
    many = contexts.where(f"kinds > {rule.many}")
    if not many.take(1):
        return out
    step = max(1, (step + 3) // 4)
    parts = scratch.cut(_part(many.select(*columns), rule, step), f"parts{level}")
    distinct = scratch.cut(_two_places(parts, _KEY, ["h0", "d1", "d2", "copy0", "s", "n", "off", "data"]).drop("h0", "d1", "d2", "copy0", "s"), f"distinct{level}")
    inner = scratch.cut(_ranges(_unsettled(distinct, scratch, f"kinds{level}"), scratch, rule, step, level + 1), f"inner{level}")
    placed = parts.where("copy0 = 0").select("h0", "d1", "d2", "s", *_KEY).join(inner, _KEY)
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("s")).alias("lo"), (r["hi"] + F.col("s")).alias("hi")))
    whole = placed.select(F.col("h0").alias("h"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), moved.alias("runs")).groupBy(*_KEY).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return out.union(whole.select(*_KEY, F.expr(_JOINED).alias("runs")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its hash dk (one to one on whole numbers; null has one too), text (null: empty) and the text's hash th."""
    return docs.select("doc_id", F.xxhash64("doc_id").alias("dk"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def repeat_places(base: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    """dk, th and ``found``, an array of (at, runs): the starts at + lo to at + hi - 1 of strings that start at two places or more.

    1. Each starting point is filed under its string's anchor; a run of starts with one anchor is a context. Equal strings
       share the anchor, so contexts whose anchor occurs once are done: most of a corpus leaves here, as a few numbers.
       This is all that hashes decide.
    2. Contexts of the other anchors are read, each at two of its places at most (more can't change what is repeated),
       and dealt by anchor: a partition holds a key range of all suffixes. Tasks fill blocks with whole anchors, transform
       the shards of a block, and merge the transforms; intervals of enough common symbols give the repeated strings.
    3. Every place of a context takes its context's starts.
    """
    every = scratch.cut(_occurrences(base, rule), "every")
    again = scratch.cut(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    seen = scratch.cut(every.join(again, "h"), "seen")
    scratch.drop("every")
    distinct = scratch.cut(_two_places(seen, _KEY, list(_PLACE)), "distinct")
    wanted = scratch.cut(_unsettled(distinct, scratch, "kinds"), "wanted")
    contexts = _fetch(base, wanted.select(*_PLACE, *_KEY, "copy"), rule)
    kinds = wanted.where("copy = 0").select("h", "kinds").distinct()
    contexts = scratch.cut(contexts, "contexts").join(scratch.cut(kinds.where(f"kinds > {rule.many}"), "hot"), "h", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long")))
    ranges = scratch.cut(_ranges(contexts, scratch, rule, rule.width), "ranges")
    found = seen.select("dk", "th", "at", *_KEY).join(ranges, _KEY).groupBy("dk", "th").agg(F.collect_list(F.struct("at", "runs")).alias("found"))
    out = scratch.cut(found, "found")
    scratch.keep("found")
    return out


def spans_of(found: pa.Array, length: int) -> pa.ListArray:
    """For each row of ``found`` (null: none) the maximal spans (start, end), in order, that strings at its starts cover."""
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(found)
    runs = pc.struct_field(flat, "runs")
    each = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
    runs = pc.list_flatten(runs)
    at = np.repeat(pc.struct_field(flat, "at").to_numpy(zero_copy_only=False), each)
    row = np.repeat(np.repeat(np.arange(len(found)), counts), each)
    start, end = at + pc.struct_field(runs, "lo").to_numpy(zero_copy_only=False), at + pc.struct_field(runs, "hi").to_numpy(zero_copy_only=False) + length - 1
    order = np.lexsort((start, row))
    start, end, row = start[order].astype(np.int64), end[order].astype(np.int64), row[order]
    gap = int(end.max(initial=0)) + 1  # rows one behind another on a line, with room between
    reach = np.maximum.accumulate(end + row * gap) if len(row) else end
    first = np.flatnonzero(np.concatenate([[True], (start + row * gap)[1:] > reach[:-1]])) if len(row) else row
    own = row[first]
    last = reach[np.append(first[1:], len(row)) - 1] - own * gap if len(row) else end
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(found)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start[first]), pa.array(last)], names=["start", "end"]))


def repeated_passages(docs: DataFrame, rule: Rule = WORDS) -> DataFrame:
    """dk, th (see ``_keyed``) and passages, an array of (start, end) in words, of documents with passages that start elsewhere too.

    A passage is a maximal run of words that strings of ``rule.length`` words cover which also start at another place, in
    the same text or in any other; white space between words doesn't matter. Nulls, repeated rows and other columns are
    as in ``remove_repeats``.
    """
    return _passages(_keyed(docs), Scratch(docs.sparkSession, "passages"), rule)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _passages(base: DataFrame, scratch: Scratch, rule: Rule) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["dk"], batch["th"], spans_of(batch["found"], rule.length)], names=["dk", "th", "passages"])

    return repeat_places(base, scratch, rule).mapInArrow(run, T.StructType([T.StructField("dk", T.LongType()), T.StructField("th", T.LongType()), T.StructField("passages", _SPANS)]))


def remove_repeats(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of removed bytes, maximal and in order) and kept (the bytes that stay) for every row.

    A byte goes if a ``rule.length``-byte string that covers it also starts at another place, in the same text or in any
    other; places are judged on the input. Texts are their UTF-8 bytes; null is empty; matches stay within a text; repeated
    rows are documents of their own and so repeat each other; shorter texts stay whole; very long texts are cut into
    overlapping segments; an empty table gives an empty one; other columns, whatever their names, are dropped.
    """
    base = _keyed(docs)
    return _removed(base, repeat_places(base, Scratch(docs.sparkSession, "repeats"), rule), rule)


def _removed(base: DataFrame, places: DataFrame, rule: Rule) -> DataFrame:
    """The result of ``remove_repeats`` with the columns of ``places`` (dk, th, found, ...) behind found."""
    more = [f for f in places.schema if f.name not in ("dk", "th", "found")]
    joined = base.join(places, ["dk", "th"], "left").select("doc_id", "text", "found", *(f.name for f in more))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", _SPANS), T.StructField("kept", T.BinaryType()), *more])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                spans = spans_of(part["found"], rule.length)
                at, edges = spans.offsets.to_pylist(), np.stack([spans.values.field("start"), spans.values.field("end")], 1).ravel().tolist()
                kept = []
                for data, a, b in zip(part["text"].cast(pa.binary()).to_pylist(), at[:-1], at[1:]):
                    own = [0, *edges[2 * a : 2 * b], len(data)]
                    kept.append(b"".join(data[x:y] for x, y in zip(own[::2], own[1::2])) if b > a else data)
                sizes = pc.cast(pc.binary_length(part["text"]), pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], sizes, spans, pa.array(kept, pa.binary()), *(part[f.name] for f in more)], names=schema.names)

    return joined.mapInArrow(run, schema)


def repeats_digest(docs: DataFrame, rule: Rule = BYTES, words: Rule = WORDS) -> DataFrame:
    """The contract's columns from the spans and kept bytes, then n_passages and n_passage_words of ``repeated_passages``."""
    base = _keyed(docs)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    passages = _passages(base, Scratch(docs.sparkSession, "passages"), words).select("dk", "th", F.size("passages").cast("long").alias("n_passages"), total("passages").alias("n_passage_words"))
    places = repeat_places(base, Scratch(docs.sparkSession, "repeats"), rule).join(passages, ["dk", "th"], "full")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return _removed(base, places, rule).select("doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), none("n_passages"), none("n_passage_words"))
