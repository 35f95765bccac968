"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import keys_only, slices

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Open bins per tier, sequences that are dealt to step groups at once, and groups they are dealt to.
OPEN, DEAL, GROUPS = 32, 64, 8
WORDS_KEPT = 400_000
JOINED = 512
#: An ASCII letter or digit before punctuation other than the apostrophe: the tokenizer always parts the two.
EDGE = r"([a-z0-9])([!-&(-/:-@\[-`{-~])"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts, by encoding each distinct white-space word once.

    The tokenizer drops white space and no step of it (composition, lower case, splitting, merges) reaches across it, so
    the ids of a text are those of its words in turn. ASCII letters are lowered and words parted at EDGE before, which
    changes no id and leaves fewer distinct words; a text that may hold a special token is left as it is. New words of
    ASCII letters alone are one piece each before merging, so many are encoded in one call and told apart by piece.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.offsets, self.lengths, self.used = [], [], 0

    def _put(self, word: str, ids: list[int]) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[word] = len(self.offsets)
        self.offsets.append(self.used)
        self.lengths.append(len(ids))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii() and w.isalpha()]
        other = [w for w in words if not (w.isascii() and w.isalpha())]
        for lo in range(0, len(plain), JOINED):
            some = plain[lo : lo + JOINED]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, piece = e.ids, np.asarray(e.word_ids)
            ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(ids)).tolist()
            if len(ends) == len(some):
                at = 0
                for w, end in zip(some, ends):
                    self._put(w, ids[at:end])
                    at = end
            else:
                other += some
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self._put(w, e.ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with the end id after each text, and the texts' bounds in them."""
        texts = pc.fill_null(texts, "")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), EDGE, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, parted))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.at) > WORDS_KEPT:
            self._reset()
        new = [w for w in distinct if w not in self.at]
        if new:
            self._learn(new)
        words = np.fromiter((self.at[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
        starts, lens = np.asarray(self.offsets, np.int64)[words] if distinct else words, np.asarray(self.lengths, np.int64)[words] if distinct else words
        before = np.concatenate([[0], np.cumsum(lens)])
        flat = self.pool[np.repeat(starts - before[:-1], lens) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.uint32)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bounds = before[ends] + np.arange(len(ends))
        out = np.full(bounds[-1], END_ID, np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[1:] - 1] = False
        out[inner] = flat
        return out, bounds


@functools.lru_cache(2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Bin:
    """An open sequence: its room, and its pieces."""

    __slots__ = ("room", "pieces", "tier")

    def __init__(self, tier: int):
        self.tier, self.room, self.pieces = tier, tier, []


class Packer:
    """Packs one partition's documents as they come, holding a bounded number of open bins.

    A piece is (document, start, ids). Whole windows of the largest tier go out at once; what is left of a document goes
    to the smallest tier that takes it and there to the fullest open bin that still has room. When a tier has too many
    open bins the fullest is closed: pieces of shorter tiers fill its gap, the largest that fit first, and one is cut
    where none fits. ``finish`` joins what is left and cuts it at powers of two, so no sequence carries padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, most_open: int = OPEN):
        self.tiers, self.most_open = tiers, most_open
        self.bins: dict[int, list[Bin]] = {t: [] for t in tiers}
        self.done: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            self.done.append([(doc, at, ids[at : at + top])])
            at += top
        if at < len(ids):
            self._place((doc, at, ids[at:]))

    def _place(self, piece) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if n <= t)
        open_bins = self.bins[tier]
        fit = min((b for b in open_bins if b.room >= n), key=lambda b: b.room, default=None)
        if fit is None:
            open_bins.append(fit := Bin(tier))
        fit.room -= n
        fit.pieces.append(piece)
        if fit.room == 0:
            open_bins.remove(fit)
            self.done.append(fit.pieces)
        elif len(open_bins) > self.most_open:
            self._close(tier)

    def _close(self, tier: int) -> None:
        closing = min(self.bins[tier], key=lambda b: b.room)
        self.bins[tier].remove(closing)
        shorter = [t for t in reversed(self.tiers) if t < tier]
        while closing.room:
            source = [b for t in shorter for b in self.bins[t]] or self.bins[tier]
            best = max(((len(p[2]), i, j) for i, b in enumerate(source) for j, p in enumerate(b.pieces) if len(p[2]) <= closing.room), default=None)
            if best:
                closing.pieces.append(self._take(source[best[1]], best[2]))
                closing.room -= best[0]
            else:  # every piece is longer than the gap: cut one
                b, gap = source[-1], closing.room
                doc, at, ids = b.pieces[-1]
                closing.pieces.append((doc, at, ids[:gap]))
                b.pieces[-1] = (doc, at + gap, ids[gap:])
                b.room += gap
                closing.room = 0
        self.done.append(closing.pieces)

    def _take(self, b: Bin, j: int):
        piece = b.pieces.pop(j)
        b.room += len(piece[2])
        if not b.pieces:
            self.bins[b.tier].remove(b)
        return piece

    def finish(self) -> None:
        left = [p for t in reversed(self.tiers) for b in self.bins[t] for p in b.pieces]
        self.bins = {t: [] for t in self.tiers}
        total, i = sum(len(p[2]) for p in left), 0
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            need, pieces = size, []
            while need:
                doc, at, ids = left[i]
                pieces.append((doc, at, ids[:need]))
                if len(ids) > need:
                    left[i] = (doc, at + need, ids[need:])
                else:
                    i += 1
                need -= len(pieces[-1][2])
            self.done.append(pieces)
            total -= size


def deal(sequences: list[list], groups: int = GROUPS) -> list[int]:
    """A step group for each sequence: the costliest first, each to the group with the least cost so far."""
    cost = [sum(len(p[2]) + len(p[2]) ** 2 / TIERS[-1] for p in s) for s in sequences]
    load, out = [0.0] * groups, [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: -cost[i]):
        g = min(range(groups), key=load.__getitem__)
        out[i] = g
        load[g] += cost[i]
    return out


OUT = (("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("doc_tokens", T.LongType(), pa.int64()), ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64()), ("tier", T.IntegerType(), pa.int32()), ("step_group", T.LongType(), pa.int64()))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: keys, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    A null text is empty: it still has the end id. Repeated rows are packed each for itself; other columns are dropped.
    Every input partition is packed by itself in one pass, so there is no shuffle, memory doesn't grow with a partition,
    and a lost task is simply run again; ``sequence_id`` and ``step_group`` carry the partition in their upper bits.
    """
    keys = list(keys)
    df = keys_only(docs, keys, text)
    path = tokenizer or default_tokenizer()

    def run(batches):
        words, packer = _tokenizer(path), Packer()
        base = TaskContext.get().partitionId() << 33
        sent = groups = 0
        key_types = None

        def out(sequences):
            nonlocal sent, groups
            cols = [[] for _ in OUT]
            rows = []
            for group, pieces in zip(deal(sequences), sequences):
                at, tier = 0, sum(len(p[2]) for p in pieces)
                for (row, total), start, ids in pieces:
                    rows.append(row)
                    for c, v in zip(cols, (start, len(ids), ids.astype("<u4").tobytes(), total, base | sent, at, tier, base | (groups + group))):
                        c.append(v)
                    at += len(ids)
                sent += 1
            groups += GROUPS
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(key_types)), *(pa.array(c, t) for c, (_, _, t) in zip(cols, OUT))], names=[*keys, *(n for n, _, _ in OUT)])

        for batch in batches:
            key_types = [batch[k].type for k in keys]
            for part in slices(batch, text):
                ids, bounds = words.encode(part[text])
                for i, row in enumerate(zip(*(part[k].to_pylist() for k in keys))):
                    packer.add((row, int(bounds[i + 1] - bounds[i])), ids[bounds[i] : bounds[i + 1]])
                    if len(packer.done) >= DEAL:
                        yield out(packer.done)
                        packer.done = []
        packer.finish()
        if packer.done:
            yield out(packer.done)

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, t) for n, t, _ in OUT)]))


def packing_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The contract's columns, then tier and step group."""
    return pack_documents(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
