"""A run-length index of some byte strings: which of their windows occur more than once.

Suffixes of the strings, joined with separators that all differ, are sorted by prefix doubling. Of the
Burrows-Wheeler transform only the runs are kept, with suffix positions sampled at both ends of each run.
Inside a run the common prefix with a neighbouring suffix is one less than that of the suffix one position
earlier in the text, so matching statistics stream through the text from sample to sample: compared at a
sample, one less with each step. A window that matches somewhere else shows as a value of its length.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes + 1)[:-1]].astype(np.int64)
        self.sizes = sizes
        # bytes are moved up by one, zero separates; no byte of UTF-8 text is 255
        joined = np.zeros(int((sizes + 1).sum()), dtype=np.uint8)
        body = np.ones(len(joined), dtype=bool)
        body[self.starts + sizes] = False
        joined[body] = np.frombuffer(b"".join(strings), np.uint8) + 1
        self.text = joined
        self.rest = np.repeat(self.starts + sizes, sizes + 1) - np.arange(len(joined))
        self._heads()
        order = self._sorted(np.repeat(np.arange(len(strings)), sizes + 1))
        before = joined[order - 1]  # the transform
        broken = (before[1:] != before[:-1]) | (before[1:] == 0)
        first, last = np.r_[True, broken], np.r_[broken, True]
        up, down = np.flatnonzero(first)[1:], np.flatnonzero(last)[:-1]
        self.runs = len(up) + 1
        #: samples at run ends: position, and the position of the neighbour beyond the run
        self.samples = ((order[up], order[up - 1]), (order[down], order[down + 1]))
        self.ends = order[0], order[-1]

    def _heads(self):
        """Eight symbols from each position on as one number, zeros from a separator on."""
        n = len(self.text)
        padded = np.r_[self.text, np.zeros(8, np.uint8)]
        heads = np.zeros(n, dtype=np.uint64)
        alive = np.ones(n, dtype=bool)
        for k in range(8):
            symbol = padded[k:k + n]
            alive &= symbol != 0
            heads = heads << np.uint64(8) | np.where(alive, symbol, 0).astype(np.uint64)
        self.heads, self.short = heads, ~alive

    def _sorted(self, owner: np.ndarray) -> np.ndarray:
        n = len(self.text)
        # what reaches a separator within the first symbols is told apart by whose separator it is
        tie = np.where(self.short, owner + 1, 0)
        order = np.lexsort((tie, self.heads))
        new = np.r_[True, (self.heads[order][1:] != self.heads[order][:-1]) | (tie[order][1:] != tie[order][:-1])]
        slots = np.flatnonzero(new)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.repeat(slots, np.diff(np.r_[slots, n]))
        step = 8
        shared = ~(new & np.r_[new[1:], True])
        while shared.any():
            places = np.flatnonzero(shared)
            members = order[places]
            key = rank[members] * n + rank[members + step]
            by = np.argsort(key, kind="stable")
            members, key = members[by], key[by]
            order[places] = members
            fresh = np.r_[True, key[1:] != key[:-1]]
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            rank[members] = places[at]
            single = fresh & np.r_[fresh[1:], True]
            shared[places[single]] = False
            step *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, inside their strings."""
        length = np.zeros(len(a), dtype=np.int64)
        active = np.arange(len(a))
        most = np.minimum(self.rest[a], self.rest[b])
        while len(active):
            x, y = a[active] + length[active], b[active] + length[active]
            differ = self.heads[x] ^ self.heads[y]
            same = differ == 0
            # leading equal bytes of eight
            bits = np.frexp(differ.astype(np.float64))[1]
            exact = np.where((differ >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0, bits - 1, bits)
            length[active] += np.where(same, 8, (64 - exact) // 8)
            active = active[same & (length[active] < most[active])]
        return np.minimum(length, most)

    def _stream(self, position: np.ndarray, neighbour: np.ndarray, end: int) -> np.ndarray:
        n = len(self.text)
        value = np.zeros(n, dtype=np.int64)
        sampled = np.zeros(n, dtype=bool)
        value[position] = self._common(position, neighbour)
        sampled[position] = True
        sampled[[0, end]] = True
        last = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        return value[last] - (np.arange(n) - last)

    def matching(self) -> np.ndarray:
        """Per position of the joined text, the longest prefix from there that also starts elsewhere."""
        (up, over), (down, under) = self.samples
        longest = np.maximum(self._stream(up, over, self.ends[0]), self._stream(down, under, self.ends[1]))
        return np.minimum(longest, self.rest)

    def repeated(self, width: int) -> list[np.ndarray]:
        """Per string, whether the window of ``width`` bytes at each offset occurs elsewhere."""
        long = self.matching() >= width
        return [long[a:a + max(0, n - width + 1)] for a, n in zip(self.starts, self.sizes)]


def ranges(flags: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges.reshape(-1, 2) - [0, 1]
