"""Suffix order of a shard by induced sorting, with queues that go to disk.

The left-most S-type suffixes are ordered first; all others follow from them. One pass over the
symbols upwards appends, to the queue of its own first symbol, the L-type suffix before each suffix
taken; a pass downwards does the same for S-type suffixes. Each queue is filled in sorted order, so
it needs no comparisons: the bucket queues together are the priority queue. A queue keeps its
newest positions in memory and moves full blocks to a temporary file, so a shard may have more
suffixes than fit. The first induction sorts the left-most S-type substrings, which are then
named; the string of names is ordered by doubling (its alphabet is too large for queues), and the
second induction gives the suffix order. Common prefixes of neighbours are carried up to the
length that matters.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Positions that one queue holds in memory.
BLOCK = 1 << 20


class Queue:
    """First in, first out; what exceeds ``BLOCK`` positions goes to a file that is gone when closed."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray | tuple[int, int]] = []  # positions, or their place in the file
        self.held, self.first_held, self.stored = 0, 0, 0
        self.file = None

    def append(self, positions: np.ndarray) -> None:
        self.parts.append(positions)
        self.held += len(positions)
        if self.held >= BLOCK:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(8 * self.stored)
            for k in range(self.first_held, len(self.parts)):
                part = self.parts[k].astype(np.int64)
                part.tofile(self.file)
                self.parts[k] = (self.stored, len(part))
                self.stored += len(part)
            self.held, self.first_held = 0, len(self.parts)

    def _read(self, part: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(part, tuple):
            self.file.seek(8 * part[0])
            return np.fromfile(self.file, np.int64, part[1])
        return part

    def _together(self, numbers: Iterator[int]) -> Iterator[list[np.ndarray]]:
        """Parts of the given numbers, as many at a time as make up a block."""
        taken: list[np.ndarray] = []
        size = 0
        for number in numbers:
            taken.append(self._read(self.parts[number]))
            size += len(taken[-1])
            if size >= BLOCK:
                yield taken
                taken, size = [], 0
        if taken:
            yield taken

    def __iter__(self) -> Iterator[np.ndarray]:
        """All positions from the first on, in blocks; also those appended meanwhile."""
        at = 0
        while at < len(self.parts):
            stop = len(self.parts)
            for parts in self._together(iter(range(at, stop))):
                yield np.concatenate(parts)
            at = stop

    def reversed_blocks(self) -> Iterator[np.ndarray]:
        for parts in self._together(iter(range(len(self.parts) - 1, -1, -1))):
            yield np.concatenate(parts[::-1])[::-1]


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the end of the text is smaller than all."""
    n = len(text)
    rises = np.zeros(n, bool)
    differs = np.zeros(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    rises[:-1] = text[:-1] < text[1:]
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return rises[following]


def _spread(queues: list[Queue], text: np.ndarray, positions: np.ndarray) -> None:
    """Append positions, in order, to the queues of their first symbols."""
    if len(positions):
        symbols = text[positions]
        order = np.argsort(symbols, kind="stable")
        positions, symbols = positions[order], symbols[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        firsts = symbols[np.concatenate([[0], cuts])]
        for symbol, part in zip(firsts.tolist(), np.split(positions, cuts)):
            queues[symbol].append(part)


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int) -> Iterator[np.ndarray]:
    """Suffix positions in order, in blocks, from the ordered left-most S-type ``seeds``."""
    seeded: list[Queue] = [Queue() for _ in range(n_symbols)]
    large: list[Queue] = [Queue() for _ in range(n_symbols)]
    small: list[Queue] = [Queue() for _ in range(n_symbols)]
    _spread(seeded, text, seeds)
    last = len(text) - 1
    large[text[last]].append(np.array([last]))  # the suffix before the text's end
    for symbol in range(n_symbols):
        for source in (large[symbol], seeded[symbol]):
            for block in source:
                before = block[block > 0] - 1
                _spread(large, text, before[~smaller[before]])
    for symbol in range(n_symbols - 1, -1, -1):
        for blocks in (iter(small[symbol]), large[symbol].reversed_blocks()):
            for block in blocks:
                before = block[block > 0] - 1
                _spread(small, text, before[smaller[before]])
    for symbol in range(n_symbols):
        yield from large[symbol]
        yield from small[symbol].reversed_blocks()


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix of ``order`` shares with the one before it, up to ``most``.

    As many symbols as fit into 64 bits are compared at a time, and one by one where these differ. The text
    is followed by a symbol that it does not have, so no suffix agrees with another beyond its end.
    """
    n, end = len(text), int(text.max(initial=0)) + 1
    bits = end.bit_length()
    step = 64 // bits
    padded = np.concatenate([text, np.full(most + step, end, text.dtype)]).astype(np.uint64)
    packed = np.zeros(n + most, np.uint64)
    for k in range(step):
        packed |= padded[k : n + most + k] << np.uint64(bits * k)
    shared = np.zeros(len(order), np.int32)
    active, a, b = np.arange(1, len(order)), order[1:].copy(), order[:-1].copy()
    for _ in range(most // step):
        same = packed[a] == packed[b]
        if not same.all():
            active, a, b = active[same], a[same], b[same]
        shared[active] += step
        a += step
        b += step
    active = np.arange(1, len(order))
    for _ in range(step - 1):
        active = active[shared[active] < most]
        a, b = order[active] + shared[active], order[active - 1] + shared[active]
        active = active[padded[a] == padded[b]]
        shared[active] += 1
    return shared


def _named(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the left-most S-type substrings, in text order; equal substrings share one."""
    ends = np.append(lms[1:], len(text) - 1)
    length = np.empty(len(text), np.int64)
    length[lms] = ends - lms + 1
    new = np.ones(len(ordered), bool)
    same = np.flatnonzero(length[ordered[1:]] == length[ordered[:-1]]) + 1
    last = ordered == lms[-1]  # it ends with the text's end, so nothing equals it
    same = same[~(last[same] | last[same - 1])]
    depth = 0
    while len(same):
        done = depth >= length[ordered[same]]
        new[same[done]] = False
        same = same[~done]
        same = same[text[ordered[same] + depth] == text[ordered[same - 1] + depth]]
        depth += 1
    names = np.empty(len(text), np.int64)
    names[ordered] = np.cumsum(new) - 1
    return names[lms]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names."""
    rank, step = names, 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        pair = rank * (len(rank) + 1) + after + 1
        order = np.argsort(pair)
        pair = pair[order]
        fresh = np.concatenate([[False], pair[1:] != pair[:-1]])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if step >= len(rank) or fresh[1:].all():
            return order


def suffix_order(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Positions of all suffixes of ``text`` (symbols below ``n_symbols``) in order."""
    if len(text) < 2:
        return np.arange(len(text))
    smaller = s_types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    seeds = lms
    if len(lms) > 1:
        marked = np.zeros(len(text), bool)
        marked[lms] = True
        ordered = np.concatenate([b[marked[b]] for b in induce(text, smaller, lms, n_symbols)])
        names = _named(text, smaller, lms, ordered)
        seeds = ordered if len(names) == names.max() + 1 else lms[_doubled(names)]
    return np.concatenate([b for b in induce(text, smaller, seeds, n_symbols)])
