"""A compressed index of sequences of symbols: their Burrows-Wheeler transform in a wavelet matrix, searched backward."""

from __future__ import annotations

import numpy as np

from .bwt import shard_transform


class WaveletMatrix:
    """Ranks of symbols in a sequence that is held as one bit vector for each bit of a symbol, with a count for every 64 bits.

    A sequence of n symbols below s takes n * log2(s) bits and half as much again for the counts.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        rest = symbols
        for level in reversed(range(self.depth)):
            bits = (rest >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.uint32))
            self.zeros.append(self.n - int(bits.sum()))
            rest = np.concatenate([rest[~bits], rest[bits]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where each ``place`` gets to when it follows the bits of its symbol: less where 0 gets to, the symbol's count before the place."""
        place = place.astype(np.int64)
        for k, (words, ones, zeros) in enumerate(zip(self.words, self.ones, self.zeros)):
            at = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            one = ones[at] + np.bitwise_count(words[at] & mask)
            place = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + one, place - one)
        return place


class FMIndex:
    """Sequences of symbols from 1 up, each ended by a 0 of its own, and what they have in common with other sequences.

    ``cap`` bounds the common prefixes that are kept: matching statistics are exact up to it.
    """

    def __init__(self, sequences: list[np.ndarray], cap: int):
        lengths = np.array([len(s) + 1 for s in sequences], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.zeros(self.bounds[-1], np.int64)
        for s, at in zip(sequences, self.bounds):
            symbols[at : at + len(s)] = s
        self.cap, self.n = cap, len(symbols)
        self.order, transform = shard_transform(symbols, self.bounds)
        self.owner = np.repeat(np.arange(len(sequences)), lengths)[self.order]
        self.matrix = WaveletMatrix(transform)
        self.symbols = int(symbols.max(initial=0)) + 1
        counts = np.bincount(symbols, minlength=self.symbols)
        every = np.arange(self.symbols)
        #: first row of the suffixes that begin with a symbol, less the place that its bits lead 0 to
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]) - self.matrix.descend(every, np.zeros(self.symbols, np.int64))
        self.common = self._common(symbols)

    def _common(self, symbols: np.ndarray) -> np.ndarray:
        """Common prefix, up to the cap, of rows i - 1 and i; -1 at both ends. Ends of sequences are equal to nothing."""
        common = np.zeros(self.n + 1, np.int16)
        common[[0, -1]] = -1
        live = np.arange(1, self.n)
        for d in range(self.cap):
            a, b = self.order[live - 1] + d, self.order[live] + d
            same = symbols[np.minimum(a, self.n - 1)]
            live = live[(same == symbols[np.minimum(b, self.n - 1)]) & (same > 0)]
            common[live] = d + 1
        return common

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = (symbol > 0) & (symbol < self.symbols)
        symbol = np.where(known, symbol, 0)
        first = self.first[symbol]
        return np.where(known, first + self.matrix.descend(symbol, low), 0), np.where(known, first + self.matrix.descend(symbol, high), 0)

    def _parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next shorter match that has more rows: its length and its interval."""
        length = np.maximum(self.common[low], self.common[high])
        for at, step in ((low, -1), (high, 1)):
            out = self._beyond(at, step, length)
            low, high = (out, high) if step < 0 else (low, out)
        return length, low, high

    def _beyond(self, at: np.ndarray, step: int, length: np.ndarray) -> np.ndarray:
        """The nearest border from ``at`` on, in the direction of step, with a common prefix below ``length``."""
        if not hasattr(self, "least"):
            self.least = [self.common]
            while 1 << len(self.least) <= len(self.common):
                half, before = 1 << (len(self.least) - 1), self.least[-1]
                self.least.append(np.minimum(before[:-half], before[half:]))
        at = at.copy()
        for k in reversed(range(len(self.least))):
            span, table = 1 << k, self.least[k]
            start = at if step > 0 else at - span + 1
            inside = (start >= 0) & (start < len(table))
            clear = inside & (table[np.where(inside, start, 0)] >= length)
            at = at + np.where(clear, step * span, 0)
        return at

    def matching_statistics(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of each query: the length of the longest match that begins there (exact up to ``cap``) and a row that it begins at.

        Queries are searched backward, all of them a symbol at a time. Where a match can't be extended it is cut behind,
        to the next shorter one with more rows. 0 and symbols the index doesn't know match nothing.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate([*queries, np.zeros(0, np.int64)]).astype(np.int64)
        length, row = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        low, high, size = np.zeros(len(queries), np.int64), np.full(len(queries), self.n), np.zeros(len(queries), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= back)
            at = starts[live] + sizes[live] - back
            todo = live
            while len(todo):
                a, b = self._extend(flat[starts[todo] + sizes[todo] - back], low[todo], high[todo])
                fits = a < b
                done, todo = todo[fits], todo[~fits]
                low[done], high[done] = a[fits], b[fits]
                size[done] += 1
                todo = todo[size[todo] > 0]
                size[todo], low[todo], high[todo] = self._parent(low[todo], high[todo])
            length[at], row[at] = size[live], low[live]
        return [(length[a:b], row[a:b]) for a, b in zip(starts, starts[1:])]

    def least_owner(self, value: np.ndarray) -> np.ndarray:
        """For each row the least ``value`` of the sequences with which it has ``cap`` symbols in common, its own included."""
        begins = np.flatnonzero(self.common[:-1] < self.cap)
        return np.repeat(np.minimum.reduceat(value[self.owner], begins), np.diff(begins, append=self.n))
