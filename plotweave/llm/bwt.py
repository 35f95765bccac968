"""Burrows-Wheeler transforms of shards of sequences, merged by refining their interleave."""

from __future__ import annotations

import numpy as np


def shard_transform(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of a shard: sequences of symbols from 1 up, each ended by a 0 of its own.

    ``symbols`` holds the sequences with their ends; ``bounds`` says where each begins. Ends are ordered by sequence, so
    no two suffixes are equal. By doubling, a suffix is ranked by its first 1, 2, 4, ... symbols. Returns the positions in
    order and the symbol before each (0 before a sequence's first).
    """
    n = len(symbols)
    ends = bounds[1:] - 1
    key = symbols.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    _, rank = np.unique(key, return_inverse=True)
    step, longest = 1, int(np.diff(bounds).max(initial=1))
    order = np.argsort(rank, kind="stable")
    while step < longest:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1  # what lies beyond a sequence's end never decides: its end is unique
        pair = rank * np.int64(n + 2) + after
        order = np.argsort(pair, kind="stable")
        line = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(line[1:] != line[:-1])])
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    before = np.concatenate([[0], symbols[:-1]])
    before[bounds[:-1]] = 0
    return order, before[order]


def merge_to_depth(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes by their first ``depth`` symbols, and common prefixes of neighbours in it.

    The interleave says which shard each place of the merged order comes from. It starts as one shard after the other;
    each round reads the shards' transforms along it and deals the places stably by the symbol read, which sorts by one
    more symbol (Holt and McMillan 2014). No suffix is sorted again. A border between two neighbours, once there, stays at
    its place, as later rounds only part what lies between borders; the round in which it appears says how many symbols
    the neighbours have in common: entry i is for places i - 1 and i, and ``depth`` where they agree that far. Ends of
    sequences stay in front with nothing in common, and so does what runs into them.
    """
    joined = np.concatenate(transforms)
    sizes = [len(t) for t in transforms]
    origin = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    small = joined.max(initial=0) < 65536
    ended = [int((t == 0).sum()) for t in transforms]  # as many ends as sequences
    front = np.repeat(np.arange(len(sizes), dtype=np.uint16), ended)
    common = np.full(len(joined), depth, np.int16)
    common[:1] = 0
    classes = np.zeros(len(joined), np.int64)
    read = np.empty(len(joined), np.uint16 if small else np.int64)
    for round_ in range(depth):
        read[np.argsort(origin, kind="stable")] = joined
        dealt = np.argsort(read, kind="stable")[len(front) :]
        symbol, came = read[dealt], classes[dealt]
        origin = np.concatenate([front, origin[dealt]])
        border = np.ones(len(joined), bool)
        border[len(front) + 1 :] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])
        common[border & (common > round_)] = round_
        classes = np.cumsum(border)
    return origin, common


def repeated_intervals(sequences: list[np.ndarray], depth: int, shard_symbols: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """interval, sequence and position of every place whose first ``depth`` symbols occur at two places or more.

    Sequences, in the order given, fill shards of about ``shard_symbols``; each shard is transformed and the transforms
    are merged. Intervals are the runs of neighbours with ``depth`` common symbols.
    """
    transforms, owners, places = [], [], []
    first = 0
    while first < len(sequences):
        last, held = first, 0
        while last < len(sequences) and (last == first or held + len(sequences[last]) + 1 <= shard_symbols):
            held += len(sequences[last]) + 1
            last += 1
        lengths = np.array([len(s) + 1 for s in sequences[first:last]])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.zeros(bounds[-1], np.int64)
        for s, at in zip(sequences[first:last], bounds):
            symbols[at : at + len(s)] = s
        order, transform = shard_transform(symbols, bounds)
        which = np.repeat(np.arange(last - first), lengths)
        transforms.append(transform)
        owners.append(first + which[order])
        places.append(order - bounds[which[order]])
        first = last
    if not transforms:
        none = np.zeros(0, np.int64)
        return none, none, none
    origin, common = merge_to_depth(transforms, depth)
    back = np.argsort(origin, kind="stable")  # places of the merged order, shard by shard
    owner, place = np.empty(len(origin), np.int64), np.empty(len(origin), np.int64)
    owner[back], place[back] = np.concatenate(owners), np.concatenate(places)
    goes_on = common >= depth
    many = goes_on | np.append(goes_on[1:], False)
    return np.cumsum(~goes_on)[many], owner[many], place[many]
