"""Enhanced suffix arrays over blocks of byte strings, and their common-prefix interval tree.

The array is built by prefix doubling in numpy. Ranks of every doubling are kept, so the longest common prefix of
any two suffixes takes a dozen comparisons. A stack scan over neighbours' common prefixes closes one interval after
the other, deepest first; an interval whose suffixes differ in what stands before them is a maximal repeat, and its
suffixes are all the repeat's occurrences. Every string ends with a separator of its own, so no match crosses it. A
string that stands at several places may be given once with their number: its first suffix is a leaf of several
occurrences, which is an interval too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FIRST = 4
#: Strings in a block: separators are 16-bit codes above the byte values.
MAX_STRINGS = 65_000


class Block:
    def __init__(self, strings: list[bytes]):
        if len(strings) > MAX_STRINGS:
            raise ValueError("too many strings in a block")
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1
        codes = np.empty(int((sizes + 1).sum()), dtype=np.uint16)
        inside = np.ones(len(codes), dtype=bool)
        inside[self.first + sizes] = False
        codes[inside] = np.frombuffer(b"".join(strings), np.uint8)
        codes[~inside] = 256 + np.arange(len(strings), dtype=np.uint16)
        self.codes, self.longest = codes, int(sizes.max(initial=0))
        self.levels = self._double()

    def _double(self) -> list[np.ndarray]:
        """levels[j][i]: rank of the FIRST * 2**j codes from i on; 0 past the end."""
        n = len(self.codes)
        padded = np.concatenate([self.codes.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
        key = np.zeros(n, dtype=np.uint64)
        for k in range(FIRST):
            key = (key << np.uint64(16)) | padded[k : n + k]
        levels, h = [self._rank(key)], FIRST
        while h <= self.longest and levels[-1].max(initial=0) < n:
            rank = levels[-1].astype(np.uint64)
            after = np.concatenate([rank[h:], np.zeros(min(h, n), np.uint64)])
            levels.append(self._rank((rank << np.uint64(32)) | after))
            h *= 2
        return levels

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), dtype=np.uint32)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else 0
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at a and at b."""
        out = np.zeros(len(a), dtype=np.int64)
        last = len(self.codes) - 1
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            x, y = a + out, b + out
            same = (x <= last) & (y <= last)
            same &= level[np.minimum(x, last)] == level[np.minimum(y, last)]
            out[same] += FIRST << j
        for _ in range(FIRST - 1):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += (self.codes[x] == self.codes[y]) & (a != b)
        return out


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, left, right) of every interval of at least that depth in a suffix order; inner ones come first."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp[1:], 0], 1):
        left = i - 1
        while stack and stack[-1][0] > depth:
            top, left = stack.pop()
            yield top, left, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


class SuffixOrder:
    """The first n_starts suffixes of each string in order, with what their neighbours share.

    A suffix at a string's first byte differs in what stands before it from every other one, so that repeats which
    are cut off there are reported too. copies: at how many places each string stands, one by default.
    """

    def __init__(self, strings: list[bytes], n_starts: list[int], copies: list[int] | None = None):
        block = Block(strings)
        starts = np.array(n_starts, dtype=np.int64)
        owner = np.repeat(np.arange(len(strings)), starts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + block.first[owner]
        before = np.where(at == block.first[owner], -1 - owner, block.codes[at - 1]) if len(at) else at
        self.order = np.argsort(block.levels[-1][at], kind="stable") if len(at) else at
        at, before = at[self.order], before[self.order]
        self.owner = owner[self.order]
        self.offset = at - block.first[self.owner]
        self.lcp = np.concatenate([[0], block.common(at[:-1], at[1:])]) if len(at) else at
        self.changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]])) if len(at) else at
        self.sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.copies = np.array(copies if copies is not None else [1] * len(strings), dtype=np.int64)

    def groups(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, left, right) of each maximal repeat of at least that many bytes: the suffixes from left to right in
        the order are all its occurrences."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.lcp >= least, [False]]).astype(np.int8)))
        first, last = edges[::2] - 1, edges[1::2] - 1  # of every run of neighbours that share as much
        pair = last == first + 1  # whose tree is one interval
        both = pair & (self.changes[first] != self.changes[last]) if len(first) else pair
        found = []
        for a, b in zip(first[~pair].tolist(), last[~pair].tolist()):
            for depth, left, right in intervals([0, *self.lcp[a + 1 : b + 1].tolist()], least):
                if self.changes[a + left] != self.changes[a + right]:
                    found.append((depth, a + left, a + right))
        leaf = np.flatnonzero((self.offset == 0) & (self.copies[self.owner] > 1) & (self.sizes[self.owner] >= least)) if len(self.order) else self.order
        size = self.sizes[self.owner[leaf]]
        alone = (self.lcp[leaf] < size) & (np.append(self.lcp, 0)[leaf + 1] < size)  # else an interval has them all
        length, left, right = np.array(found, dtype=np.int64).reshape(-1, 3).T
        return np.concatenate([self.lcp[last[both]], length, size[alone]]), np.concatenate([first[both], left, leaf[alone]]), np.concatenate([last[both], right, leaf[alone]])

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, strings, offsets) of each maximal repeat of at least that many bytes, with all its occurrences."""
        for length, left, right in zip(*(x.tolist() for x in self.groups(least))):
            yield length, self.owner[left : right + 1], self.offset[left : right + 1]

    def longest(self, least: int) -> np.ndarray:
        """For each start, string by string, the length of the longest maximal repeat that has an occurrence there, or 0."""
        depth = np.zeros(len(self.lcp), dtype=np.int64)
        length, left, right = self.groups(least)
        few = right <= left + 1
        for end in (left, right):
            np.maximum.at(depth, end[few], length[few])
        for size, a, b in zip(length[~few].tolist(), left[~few].tolist(), right[~few].tolist()):
            np.maximum(depth[a : b + 1], size, out=depth[a : b + 1])
        out = np.empty_like(depth)
        out[self.order] = depth
        return out
