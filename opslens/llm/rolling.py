"""Polynomial prefix hashes: the hash of any piece of a text from two sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
# A random odd number for each byte.
BYTES = np.random.default_rng(0).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KNOWN: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    if base not in _KNOWN or len(_KNOWN[base]) < count:
        out = np.ones(1, np.uint64)
        while len(out) < max(count, 1 << 16):
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        _KNOWN[base] = out
    return _KNOWN[base][:count]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes (mod 2^64, over random numbers for the bytes) of all pieces of a text."""

    def __init__(self, text: np.ndarray):
        self.back = powers(_INVERSE, len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(BYTES[text] * powers(BASE, len(text)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])
