"""Signature trees over sets of 64-bit tokens, and their dual traversal.

Every set has a bitmap of its tokens and a size. Sets are put in order of size and then of bitmap, and packed into a
tree whose nodes hold the OR of the bitmaps below, the range of sizes, and the largest excess (tokens that share a bit
with another token of their set). For sets a and b below nodes A and B, every common token has its bit in both ORs, so

    overlap(a, b) <= popcount(OR(A) & OR(B)) + min(excess(A), excess(B)).

A pair of nodes is dropped when that bound, or the ranges of sizes, rule out the similarity. Pairs of sets are bounded
again by their own bitmaps: each bit of a that b lacks is a token that b lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FANOUT = 8


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: a power of two, two to four bits a token."""
    return 1 << min(17, max(6, int(3 * n - 1).bit_length()))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    n = bits // 64
    return np.bitwise_or.reduce(words.reshape(-1, n), axis=0)


def possible(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap allows ``100 * overlap >= percent * union``."""
    return (100 + percent) * overlap >= percent * (na + nb)


class Tree:
    """Levels from the leaves' members up to the root; each an array of bitmaps, least and largest size, excess."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        sizes = sizes.astype(np.int64)
        self.order = np.lexsort((*maps.T[: min(4, maps.shape[1])], sizes))
        maps, sizes = maps[self.order], sizes[self.order]
        excess = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def span(self, level: int, node: int) -> tuple[int, int]:
        """Members below a node."""
        width = FANOUT**level
        return node * width, min(len(self.order), (node + 1) * width)

    def pairs(self, percent: int, same: Callable[[int, int, int, int], bool]) -> Iterator[tuple[int, int]]:
        """Pairs of members that may be similar, by dual traversal. ``same(a0, a1, b0, b1)`` says that two ranges of
        members are known to belong together already; such node pairs are passed over when they are reached."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if same(*self.span(level, a), *self.span(level, b)):
                continue
            if level == 0:
                if a != b:
                    yield int(self.order[a]), int(self.order[b])
                continue
            m, lo, hi, ex = self.levels[level - 1]
            left = np.arange(a * FANOUT, min(len(m), (a + 1) * FANOUT))
            right = left if a == b else np.arange(b * FANOUT, min(len(m), (b + 1) * FANOUT))
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            keep = (i <= j) if level > 1 or a != b else (i < j)
            i, j = i[keep], j[keep]
            # sizes alone, then the bound of the bitmaps
            keep = (100 * np.minimum(hi[i], hi[j]) >= percent * np.maximum(lo[i], lo[j])) | (i == j)
            i, j = i[keep], j[keep]
            if level == 1:
                bound = np.minimum(lo[i] - np.bitwise_count(m[i] & ~m[j]).sum(1).astype(np.int64), lo[j] - np.bitwise_count(m[j] & ~m[i]).sum(1).astype(np.int64))
            else:
                bound = np.bitwise_count(m[i] & m[j]).sum(1).astype(np.int64) + np.minimum(ex[i], ex[j])
            keep = possible(np.minimum(bound, np.minimum(hi[i], hi[j])), lo[i], lo[j], percent) | (i == j)
            i, j = i[keep], j[keep]
            own = i == j  # a node with itself is visited first, so that what it links is known to the others
            stack += [(level - 1, int(x), int(y)) for x, y in zip(i[~own], j[~own], strict=True)][::-1]
            stack += [(level - 1, int(x), int(x)) for x in i[own]][::-1]


def _known(tree: Tree, roots: Callable[[int], int]) -> Callable[[int, int, int, int], bool]:
    """Whether all members of two ranges have one root. Once a range has one root, it always will."""
    uniform: dict[tuple[int, int], int] = {}

    def one(a: int, b: int) -> int:
        if (a, b) in uniform:
            return roots(uniform[a, b])
        first = roots(int(tree.order[a]))
        for k in range(a + 1, b):
            if roots(int(tree.order[k])) != first:
                return -1 - a
        uniform[a, b] = int(tree.order[a])
        return first

    def same(a0: int, a1: int, b0: int, b1: int) -> bool:
        if (a0, a1) == (b0, b1) and a1 - a0 == 1:
            return True
        x = one(a0, a1)
        return x >= 0 and x == one(b0, b1)

    return same


def link_sets(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> UnionFind:
    """Components of sets (sorted, distinct tokens) that are similar; verified, and passing over what is linked.
    ``known`` may name a set that each is linked with already."""
    links = UnionFind(len(sets))
    for a, b in enumerate(known or ()):
        links.join(a, b)
    if len(sets) > 1:
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = min(1 << 17, 4 * bits_for(int(sizes.max())))  # the sets are here, so bitmaps may be finer
        tree = Tree(np.stack([bitmap(s, bits) for s in sets]), sizes)
        for a, b in tree.pairs(percent, _known(tree, links.find)):
            if links.find(a) != links.find(b):
                overlap = np.intersect1d(sets[a], sets[b], assume_unique=True).size
                if (100 + percent) * overlap >= percent * (len(sets[a]) + len(sets[b])):
                    links.join(a, b)
    return links


def link_candidates(maps: list[np.ndarray], sizes: np.ndarray, members: list[int], links: UnionFind, percent: int) -> list[tuple[int, int]]:
    """Join in ``links`` all ``members`` whose bitmaps do not rule out similarity; the pairs that made a difference.
    Bitmaps may differ in length: similar sets' lengths differ by one step at most, so neighbouring lengths are compared
    at the smaller one."""
    found = []
    lengths = np.array([maps[k].size for k in members])
    for n in np.unique(lengths):
        own = [k for k, size in zip(members, lengths, strict=True) if size in (n, 2 * n)]
        if len({links.find(k) for k in own}) < 2:
            continue
        tree = Tree(np.stack([fold(maps[k], int(n) * 64) for k in own]), sizes[own])
        for a, b in tree.pairs(percent, _known(tree, lambda k, own=own: links.find(own[k]))):
            if links.find(own[a]) != links.find(own[b]):
                links.join(own[a], own[b])
                found.append((own[a], own[b]))
    return found
