"""Words of whole batches of texts at once: bounds and 64-bit hashes by NumPy, without a Python loop over words.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials modulo 2**64 over random byte
values, taken as differences of one running sum, and mixed afterwards.
"""

from __future__ import annotations

import numpy as np

#: Bytes of texts handled at once: some ten arrays of eight bytes for each are alive at a time.
BATCH = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD = ~SPACE
CODE_POINT = np.ones(256, bool)
CODE_POINT[0x80:0xC0] = False
_VALUES = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Running polynomial sum over bytes: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers_to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _LENGTH)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = BATCH) -> np.ndarray:
    """Prefix.span of runs that follow one another without overlap, with running sums of `most` bytes at a time: what a
    long text holds in memory is its runs, not several numbers for each byte."""
    if len(data) <= most:
        return Prefix(data).span(start, end)
    raw = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), most):
        b = min(a + most, len(data))
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        if lo >= hi:
            continue
        part = Prefix(data[a:b]).raw(np.maximum(start[lo:hi], a) - a, np.minimum(end[lo:hi], b) - a)
        if start[lo] < a:
            part[:1] *= np.uint64(pow(_BASE, a - int(start[lo]), 2**64))
        raw[lo:hi] += part
    return mix(raw + (end - start).astype(np.uint64) * _LENGTH)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the row that each is in."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = WORD[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    first = np.flatnonzero(start)
    last = np.flatnonzero(end) + 1
    return first, last, np.searchsorted(offsets, first, side="right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    sums = np.zeros(len(flags) + 1, np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of `size` words within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]) if i % 2 else total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return first, mix(total[first])
