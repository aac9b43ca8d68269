"""Hashes of words and word windows, vectorised over many texts at once (used inside tasks)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WORD_BASE, _WINDOW_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection on 64 bits)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    hashes, counts, group, size = [], [], [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size > 2_000_000 or i == len(texts) - 1:
            h, c = _hash_group(group, lower)
            hashes.append(h)
            counts.append(c)
            group, size = [], 0
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_group(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # the space keeps words from crossing texts
    if lower:
        buf = _LOWER[buf]
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    lens = ends - starts
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    sums = np.add.reduceat(_BYTE[buf[inside]] * _powers(_WORD_BASE, int(lens.max()))[place], at)
    return mix(sums + lens.astype(np.uint64)), counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last ``size - 1`` places have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(_powers(_WINDOW_BASE, size)):
        out += words[k : k + n] * p
    return mix(out)


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Places, in the words of all texts end to end, from which ``size`` words lie in one text."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return np.flatnonzero(left >= size)
