"""A tree over token sets: nodes hold OR-combined bitmaps and size ranges; two nodes are traversed together.

A set of n tokens has a bitmap of w bits (a power of two of about 2 to 4 n), a token's bit being its lowest bits,
and an excess: tokens less bits set. Two sets share at most as many tokens as their bitmaps share bits, plus
the lesser excess: a token of both sets a bit in both, and tokens beyond the first on a bit are excess of
each. The same holds for nodes with OR-combined bitmaps, the largest sizes and the largest excesses, so a
pair of nodes is left where even that falls short of what the threshold asks of the smallest sizes. A wider
bitmap is folded to the other's width. A set may come with a cap on what it can share with any other here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LEAF, FAN = 16, 4


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of distinct tokens."""
    w = width(len(tokens))
    bits = np.zeros(w, np.uint8)
    bits[(tokens & np.uint64(w - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """The bitmap (or rows of bitmaps) at a lesser width."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The least number of shared tokens with which sets of sizes a and b have percent/100 of their union in common."""
    return -(-percent * (a + b) // (100 + percent))


class Node:
    __slots__ = ("bits", "cap", "children", "excess", "high", "hi", "lo", "low")

    def __init__(self, lo: int, hi: int, low: int, high: int, cap: int, excess: int, bits: np.ndarray, children: list[Node]):
        self.lo, self.hi, self.low, self.high, self.cap, self.excess, self.bits, self.children = lo, hi, low, high, cap, excess, bits, children


class Tree:
    """Over sets ordered by size. sizes: tokens of each; bitmaps: its 64-bit words; labels: sets of a label need no pairs;
    caps: the most tokens that each can share with another set here (its size, if not given); cut: only pairs of one of
    the first cut sets and one of the others are wanted, which are then two trees, traversed together."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray, percent: int = 80, caps: np.ndarray | None = None, cut: int | None = None):
        ends = [0, len(sizes)] if cut is None else [0, cut, len(sizes)]
        order = np.concatenate([a + np.argsort(sizes[a:b], kind="stable") for a, b in zip(ends[:-1], ends[1:], strict=True)])
        self.order, self.percent = order, percent
        self.size, self.label = sizes[order].astype(np.int64), labels[order].copy()
        self.cap = (sizes if caps is None else caps)[order].astype(np.int64)
        self.rows = [bitmaps[k] for k in order]
        self.pairs_seen = self.nodes_seen = 0
        self.roots = [self._grown(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if b > a]
        self.halves = cut is not None

    def _grown(self, a: int, b: int) -> Node:
        level = [self._leaf(k, min(k + LEAF, b)) for k in range(a, b, LEAF)]
        while len(level) > 1:
            level = [self._join(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        return level[0]

    def _leaf(self, a: int, b: int) -> Node:
        words = min(len(x) for x in self.rows[a:b])
        raw = np.stack([fold(x, words) for x in self.rows[a:b]])
        excess = self.size[a:b] - np.bitwise_count(raw).sum(1).astype(np.int64)
        return Node(a, b, int(self.size[a]), int(self.size[b - 1]), int(self.cap[a:b].max()), int(excess.max()), np.bitwise_or.reduce(raw), [])

    @staticmethod
    def _join(nodes: list[Node]) -> Node:
        if len(nodes) == 1:
            return nodes[0]
        words = min(len(n.bits) for n in nodes)
        bits = np.bitwise_or.reduce(np.stack([fold(n.bits, words) for n in nodes]))
        # folding hides further tokens: of a set at most as many more as bits are lost, so take the worst case
        excess = max(n.excess if len(n.bits) == words else n.high for n in nodes)
        return Node(nodes[0].lo, nodes[-1].hi, min(n.low for n in nodes), max(n.high for n in nodes), max(n.cap for n in nodes), excess, bits, nodes)

    def _possible(self, x: Node, y: Node) -> bool:
        self.nodes_seen += 1
        if x.high * 100 < self.percent * y.low or y.high * 100 < self.percent * x.low:
            return False
        a, b = self.label[x.lo : x.hi], self.label[y.lo : y.hi]
        if a[0] == b[0] and (a == a[0]).all() and (b == b[0]).all():
            return False
        words = min(len(x.bits), len(y.bits))
        ex = x.excess if len(x.bits) == words else x.high
        ey = y.excess if len(y.bits) == words else y.high
        common = int(np.bitwise_count(fold(x.bits, words) & fold(y.bits, words)).sum()) + min(ex, ey)
        return min(common, x.cap, y.cap) >= needed(x.low, y.low, self.percent)

    def _both(self, x: Node, y: Node) -> Iterator[tuple[Node, Node]]:
        if not self._possible(x, y):
            return
        if not x.children and not y.children:
            yield x, y
        elif x.children and (not y.children or x.hi - x.lo >= y.hi - y.lo):
            for c in x.children:
                yield from self._both(c, y)
        else:
            for c in y.children:
                yield from self._both(x, c)

    def _own(self, x: Node) -> Iterator[tuple[Node, Node]]:
        if not x.children:
            yield x, x
            return
        for c in x.children:
            yield from self._own(c)
        for k, c in enumerate(x.children):
            for d in x.children[k + 1 :]:
                yield from self._both(c, d)

    def leaves(self) -> Iterator[tuple[Node, Node]]:
        """Pairs of leaves (a leaf with itself, too) that may hold a pair of sets that reach the threshold."""
        if self.halves:
            if len(self.roots) == 2:
                yield from self._both(*self.roots)
        elif self.roots:
            yield from self._own(self.roots[0])

    def shares(self, x: Node, y: Node) -> np.ndarray:
        """For each set of leaf x and each of y the share of their union that they may have in common; -1 for pairs that
        can't reach the threshold, of one label, or seen from the other side."""
        words = min(min(len(r) for r in self.rows[x.lo : x.hi]), min(len(r) for r in self.rows[y.lo : y.hi]))
        a = np.stack([fold(r, words) for r in self.rows[x.lo : x.hi]])
        b = a if x is y else np.stack([fold(r, words) for r in self.rows[y.lo : y.hi]])
        na, nb = self.size[x.lo : x.hi], self.size[y.lo : y.hi]
        ea = na - np.bitwise_count(a).sum(1).astype(np.int64)
        eb = nb - np.bitwise_count(b).sum(1).astype(np.int64)
        common = np.bitwise_count(a[:, None] & b[None]).sum(2).astype(np.int64) + np.minimum(ea[:, None], eb[None])
        ok = np.minimum(common, np.minimum(self.cap[x.lo : x.hi, None], self.cap[None, y.lo : y.hi])) >= needed(na[:, None], nb[None], self.percent)
        if x is y:
            ok = np.triu(ok, 1)
        self.pairs_seen += ok.size
        ok &= self.label[x.lo : x.hi, None] != self.label[None, y.lo : y.hi]
        return np.where(ok, common / np.maximum(na[:, None] + nb[None] - common, 1), -1.0)

    def pairs(self) -> np.ndarray:
        """All pairs (rows of two) of sets with different labels that may reach the threshold."""
        out = [np.zeros((0, 2), np.int64)]
        for x, y in self.leaves():
            p, q = np.nonzero(self.shares(x, y) >= 0)
            out.append(np.stack([self.order[x.lo + p], self.order[y.lo + q]], 1))
        return np.concatenate(out)

    def links(self, alike: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
        """Pairs that are alike, each of which joins two labels, taken as one from then on; the likeliest of two leaves are
        tried first. What is left has no two sets alike with different labels."""
        for x, y in self.leaves():
            share = self.shares(x, y)
            tried = np.argwhere(share >= 0)
            for p, q in tried[np.argsort(-share[tried[:, 0], tried[:, 1]], kind="stable")].tolist():
                i, j = x.lo + p, y.lo + q
                if self.label[i] != self.label[j] and alike(int(self.order[i]), int(self.order[j])):
                    yield int(self.order[i]), int(self.order[j])
                    self.label[self.label == self.label[j]] = self.label[i]
