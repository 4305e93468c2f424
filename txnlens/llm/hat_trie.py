"""A counting trie over word numbers with burstable hash containers (numpy).

Keys are phrases packed into 63 bits, ``BITS`` for each word number, the first word
foremost; unused places are 0, numbers start at 1. Sorted keys are phrases in order, and
all phrases with the same first words are neighbours.

A node splits its phrases by the word at its depth. Its children are containers, each
holding a range of words, or further nodes for single words. A container that passes
``burst`` entries bursts: one that holds several words is cut in two at the word in its
middle, one that holds a single word becomes a node of the next depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS, WORDS = 21, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Container:
    """Open addressing: ``keys`` (0 for a free slot) and ``counts``, whole arrays at a time."""

    def __init__(self, capacity: int = 64):
        self.keys, self.counts, self.n = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds to the counts of distinct keys."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.entries()
            self.__init__(1 << int(4 * (len(held[0]) + len(keys)) - 1).bit_length())
            self._put(*held)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = ((keys.astype(np.uint64) * _MIX) >> np.uint64(32)).astype(np.int64) & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several that claim a slot the last one stays
            mine = self.keys[slot] == keys
            self.counts[slot[mine]] += counts[mine]
            self.n += int((free & mine).sum())
            keys, counts, slot = keys[~mine], counts[~mine], (slot[~mine] + 1) & mask

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        held = np.flatnonzero(self.keys)
        return self.keys[held], self.counts[held]

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, counts = self.entries()
        order = np.argsort(keys)
        yield keys[order], counts[order]


class Node:
    """Children by ascending ranges: child ``i`` holds the keys from ``lows[i]`` up to ``lows[i + 1]``."""

    def __init__(self, depth: int, burst: int, first: Container | None = None):
        self.shift, self.depth, self.burst = BITS * (WORDS - 1 - depth), depth, burst
        self.lows, self.children, self.n = np.zeros(1, np.int64), [first or Container()], (first.n if first else 0)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds to the counts of distinct keys, which ascend."""
        cuts = np.append(np.searchsorted(keys, self.lows[1:]), len(keys))
        begin = 0
        full = []
        for i, end in enumerate(cuts.tolist()):
            if end > begin:
                child = self.children[i]
                child.add(keys[begin:end], counts[begin:end])
                if isinstance(child, Container) and child.n > self.burst:
                    full.append(i)
            begin = end
        for i in reversed(full):
            self._burst(i)
        self.n = sum(c.n for c in self.children)

    def _burst(self, i: int) -> None:
        keys, counts = next(self.children[i].runs())
        words = keys >> self.shift
        if words[0] == words[-1]:
            if self.depth < WORDS - 1:
                below = Node(self.depth + 1, self.burst, self.children[i])
                below.lows[0] = words[0] << self.shift
                self.children[i] = below
            return
        middle = words[len(words) // 2]
        cut = middle if middle > words[0] else words[np.searchsorted(words, middle, "right")]
        at = int(np.searchsorted(words, cut))
        halves = []
        for part in (slice(0, at), slice(at, None)):
            half = Container()
            half.add(keys[part], counts[part])
            halves.append(half)
        self.children[i : i + 1] = halves
        self.lows = np.insert(self.lows, i + 1, cut << self.shift)
        for j in (i + 1, i):  # a half may still be over the limit
            if self.children[j].n > self.burst:
                self._burst(j)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries in order, some at a time."""
        for child in self.children:
            yield from child.runs()

    def spill(self, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties the largest subtrees, each as a sorted run, until no more than ``room`` entries are left."""
        for i in sorted(range(len(self.children)), key=lambda k: -self.children[k].n):
            if self.n <= room:
                return
            child, self.children[i] = self.children[i], Container()
            self.n -= child.n
            yield from child.runs()
