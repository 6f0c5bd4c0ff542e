"""Suffix trees of pieces of text, over words, and the repeats that their deep nodes show.

Words are numbered and every piece ends in a sign of its own, so no match leaves a piece.  Prefix
doubling ranks all places by their first 1, 2, 4, ... words; the last ranks order the suffixes, and
the ranks of all lengths give the common prefixes of neighbours.  Where these are deep enough the
tree is built: nodes with depth, parent and the smallest document below.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class SuffixTree:
    """The deep part of a suffix tree: nodes at a depth of ``least_depth`` words and more.

    ``leaves`` are places of the joined text in the order of their suffixes, ``leaf_parent`` their
    nodes (-1: under none); nodes have ``depth``, ``parent`` (-1: none that deep) and ``least``, the
    smallest document below."""

    def __init__(self, pieces: list[list[bytes]], docs: list[int], least_depth: int):
        sizes = np.array([len(p) for p in pieces], np.int64)
        words = pa.array([w for p in pieces for w in p], pa.binary()).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        text = np.insert(codes, ends, len(words.dictionary) + np.arange(len(pieces)))  # a sign of its own ends each piece
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        room = np.maximum(sizes - least_depth + 1, 0)
        place = np.repeat(self.starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        owner = np.repeat(np.arange(len(pieces)), room)
        levels, span = [text], 1
        while span <= int(sizes.max(initial=0)):
            ranks = levels[-1]
            second = np.zeros(text.size, np.int64)
            second[:-span] = ranks[span:] + 1
            levels.append(np.unique(ranks * (int(ranks.max()) + 2) + second, return_inverse=True)[1])
            span *= 2
        order = np.argsort(levels[-1][place], kind="stable")
        self.leaves, self.piece = place[order], owner[order]
        self.doc = np.array(docs, np.int64)[self.piece]
        self.common = self._common(levels)
        self.leaf_parent, self.depth, self.parent, self.least = self._nodes(least_depth)

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each leaf shares with the leaf before it (the first: none)."""
        a, b = self.leaves[:-1].copy(), self.leaves[1:].copy()
        shared, last = np.zeros(max(self.leaves.size - 1, 0), np.int64), levels[0].size - 1
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            same = (x <= last) & (y <= last)
            same &= levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)]
            shared += same * (1 << k)
        return np.append(np.zeros(min(1, self.leaves.size), np.int64), shared)

    def _nodes(self, least_depth: int):
        n = self.leaves.size
        leaf_parent, depth, parent, least = np.full(n, -1, np.int64), [], [], []
        deep = self.common >= least_depth
        # stretches of leaves under one deep node, with more than one document below it
        heads = np.flatnonzero(~deep)
        tails = np.append(heads[1:], n)
        if n:
            low, high = np.minimum.reduceat(self.doc, heads), np.maximum.reduceat(self.doc, heads)
            worth = np.flatnonzero(low < high)
        else:
            worth = []
        for s, e in zip(heads[worth].tolist(), tails[worth].tolist(), strict=True):
            common, doc = self.common[s:e].tolist(), self.doc[s:e].tolist()
            stack: list[int] = []
            for i in range(1, e - s + 1):
                shared = common[i] if i < e - s else least_depth - 1
                node, below = -1, doc[i - 1]  # the leaf before, then the nodes that it closes
                while stack and depth[stack[-1]] > shared:
                    top = stack.pop()
                    if node < 0:
                        leaf_parent[s + i - 1] = top
                    else:
                        parent[node] = top
                    if below < least[top]:
                        least[top] = below
                    node, below = top, least[top]
                if shared < least_depth:
                    break
                if not stack or depth[stack[-1]] < shared:
                    depth.append(shared)
                    parent.append(-1)
                    least.append(below)
                    stack.append(len(depth) - 1)
                top = stack[-1]
                if node < 0:
                    leaf_parent[s + i - 1] = top
                else:
                    parent[node] = top
                if below < least[top]:
                    least[top] = below
        return leaf_parent, np.array(depth, np.int64), np.array(parent, np.int64), np.array(least, np.int64)

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``piece, place in it, words``: of each suffix the longest prefix that a smaller document has, too.

        That is the deepest node above it with a smaller document below.  Going up, the smallest
        document never grows, so it is the leaf's own node, or the next one above with a smaller one."""
        jump = np.full(self.depth.size, -1, np.int64)
        parent, least = self.parent.tolist(), self.least.tolist()
        for v in sorted(range(len(parent)), key=self.depth.tolist().__getitem__):  # parents are less deep
            up = parent[v]
            if up >= 0:
                jump[v] = up if least[up] < least[v] else jump[up]
        leaf = np.flatnonzero(self.leaf_parent >= 0)
        own = self.leaf_parent[leaf]
        node = np.where(self.least[own] < self.doc[leaf], own, jump[own]) if leaf.size else leaf
        hit = node >= 0
        leaf, node = leaf[hit], node[hit]
        piece = self.piece[leaf]
        return piece, self.leaves[leaf] - self.starts[piece], self.depth[node]


def repeated_runs(pieces: list[list[bytes]], docs: list[int], window: int) -> list[tuple[int, int, int]]:
    """``piece, start, windows``: runs of consecutive windows that a smaller document has, too, each a
    maximal repeat of its piece."""
    piece, start, words = SuffixTree(pieces, docs, window).repeats()
    if not piece.size:
        return []
    order = np.lexsort((start, piece))
    piece, start, stop = piece[order], start[order], (start + words - window + 1)[order]
    # windows up to the furthest end so far are one run, as long as the next begins no later
    wide = np.int64(stop.max() + 2)
    reach = np.maximum.accumulate(stop + piece * wide)
    opens = np.flatnonzero(np.append(True, start[1:] + piece[1:] * wide > reach[:-1]))
    ends = reach[np.append(opens[1:], piece.size) - 1]
    return list(zip(piece[opens].tolist(), start[opens].tolist(), (ends - piece[opens] * wide - start[opens]).tolist(), strict=True))
