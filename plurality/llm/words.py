"""Vectorised word hashing for tasks: words, word windows, winnowed anchors.

Words are runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text, hashed
to 64 bits. A window of k words is hashed from its word hashes. All functions
work on the words of several texts laid end to end; ``ends`` are the positions
after each text's last word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: odd multipliers of the polynomial hashes
BYTE_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    inverse = pow(base, -1, 1 << 64)

    def run(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base), run(inverse)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    a, b = _powers(base, size)
    return a[:n], b[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def _hash_block(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and their first bytes' positions."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, after = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    sums = _sums(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    return mix((sums[after] - sums[first]) * powers(BYTE_BASE, len(raw))[1][first]), first


def _long_text(data: bytes, lower: bool) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        gap = _GAP.search(data, min(len(data), at + BLOCK_BYTES))
        stop = gap.start() if gap else len(data)
        parts.append(_hash_block(data[at:stop], lower)[0])
        at = stop + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def hashed(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, ends) for runs of texts of about BLOCK_BYTES; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK_BYTES:
            h = _long_text(texts[at], lower)
            yield at, h, np.array([len(h)])
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BLOCK_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        h, first = _hash_block(b" ".join(texts[at:stop]), lower)
        yield at, h, np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts[at:stop]]))
        at = stop


def room(ends: np.ndarray, n: int) -> np.ndarray:
    """For each word, how many words its text has from it on."""
    starts = np.concatenate(([0], ends[:-1]))
    return np.repeat(ends, ends - starts) - np.arange(n)


def windows(h: np.ndarray, k: int, base: int = WINDOW_BASE, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out. Windows that cross texts are not meant to be used."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    sums = _sums(h, base)
    return mix((sums[k:] - sums[:-k]) * powers(base, len(h))[1][: len(h) - k + 1], seed)


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each w neighbouring values, by doubling."""
    width, out = 1, a
    while 2 * width <= w:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[: len(a) - w + 1], out[w - width : w - width + len(a) - w + 1])


def winnow(grams: np.ndarray, left: np.ndarray, w: int) -> np.ndarray:
    """Positions of grams that are the least of some w neighbouring grams of one text.

    ``left``: how many grams the text has from each position on (not positive: none).
    Every run of w grams in a text holds a chosen one, and equal runs in two
    texts hold the same.
    """
    if len(grams) < w:
        return np.zeros(0, np.int64)
    least = sliding(grams, w, np.minimum)
    least = np.where(left[: len(least)] >= w, least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    best = sliding(np.concatenate((pad, least, pad)), w, np.maximum)
    return np.flatnonzero((best == grams) & (left[: len(grams)] > 0) & (best > 0))
