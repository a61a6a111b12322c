"""Vectorised tokenising and rolling hashes over a block's bytes.

A word's hash is a sum over its pieces of eight bytes, each mixed with its place: no polynomial, whose values modulo
2**64 have collisions by construction (complementary Thue-Morse words of 1,024 bytes and more). A window's hash is a
polynomial modulo 2**64 over the mixed hashes of a few words, by prefix sums: one subtraction and one product. Hashes are
mixed before use, so that order and partition by value are even. Two different values share 64 bits with a chance of
about n**2 / 2**65 over n values: 1e-3 for 2e8, so what is decided by hashes alone takes ``more_bits`` too.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
GOLDEN = 0xD1B54A32D192ED03
FULL = np.uint64((1 << 64) - 1)
LONG_PIECES = 4
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up, out=out[1:])
    return out


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span, from all of its bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    sizes = end - begin
    pieces = (sizes + 7) >> 3
    total = np.zeros(len(begin), np.uint64)
    rows = np.arange(len(begin))
    for k in range(int(pieces.max(initial=0))):
        if k:
            rows = rows[pieces[rows] > k]
        if k == LONG_PIECES:
            break
        left = np.minimum(sizes[rows] - 8 * k, 8).astype(np.uint64)
        piece = eights[begin[rows] + 8 * k] & (FULL >> ((np.uint64(8) - left) * np.uint64(8)))
        total[rows] += mix(piece + np.uint64(GOLDEN * (k + 1) & (1 << 64) - 1))
    else:
        rows = rows[:0]
    for i in rows.tolist():  # the pieces from LONG_PIECES on of a few long words
        a, b = int(begin[i]) + 8 * LONG_PIECES, int(end[i])
        piece = eights[a:b:8].copy()
        if (b - a) % 8:
            piece[-1] &= FULL >> np.uint64(8 * (8 - (b - a) % 8))
        places = np.arange(LONG_PIECES + 1, LONG_PIECES + 1 + len(piece), dtype=np.uint64) * np.uint64(GOLDEN)
        total[i : i + 1] += np.add.reduce(mix(piece + places))
    return mix(total + sizes.astype(np.uint64))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """One mixed hash for each full window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values)
    return mix((sums[width:] - sums[:-width]) * powers(len(values))[1][:n])


def token_table(pattern: str) -> np.ndarray:
    """A boolean for each byte value: 'words' (all but ASCII white space) or 'alnum' (0-9, a-z, A-Z and above 0x7F)."""
    table = np.ones(256, bool)
    if pattern == "words":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Tokens:
    """Words of a block: byte spans, 64-bit hashes, and the first word of each document (one more than documents)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, pattern: str = "words", lower: bool = False):
        inside = token_table(pattern)[data]
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cuts = starts[(starts > 0) & (starts < len(data))]
            begin[cuts] = inside[cuts]
            end[cuts - 1] = inside[cuts - 1]
        self.begin = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, starts)
        self.counts = np.diff(self.first)
        self.hashes = word_hashes(LOWER[data] if lower else data, self.begin, self.end)
        self.doc = np.repeat(np.arange(len(starts) - 1), self.counts)

    def local(self) -> np.ndarray:
        """The place of each word in its document."""
        return np.arange(len(self.begin)) - self.first[:-1][self.doc]

    def more_bits(self, width: int) -> np.ndarray:
        """A second hash of the window at each word, of 32 bits that do not depend on the first."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint32)
        if n >= width:
            out[: n - width + 1] = window_hashes(mix(self.hashes ^ np.uint64(GOLDEN)), width) >> np.uint64(32)
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at each word, and whether the window lies in one document."""
        n = len(self.hashes)
        out, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= width:
            out[: n - width + 1] = window_hashes(self.hashes, width)
            whole[: n - width + 1] = self.doc[width - 1 :] == self.doc[: n - width + 1]
        return out, whole


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
