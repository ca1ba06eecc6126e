"""A minimal perfect hash over pairs of 64-bit hashes: levels of bit arrays, slots by rank.

A level is a bit array of ``GAMMA`` bits a key; a bit is set where exactly one key falls, keys that
collide go on to the next level. A key's slot is the number of set bits before its own, over all
levels, so n keys have the slots 0 to n-1. Keys must be distinct pairs.
"""

from __future__ import annotations

import numpy as np

from .bytetext import mix

_U = np.uint64
#: Bits of a level for each key that comes to it.
GAMMA = 2


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(h1 ^ mix(h2 + _U(level * 0x9E3779B97F4A7C15 % 2**64))) % _U(bits)).astype(np.int64)


class PerfectHash:
    """``sizes`` holds the 64-bit words of each level, ``words`` all levels after one another."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = list(sizes), words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        left, sizes, words = np.arange(len(h1)), [], []
        while len(left):
            size = -(-GAMMA * len(left) // 64)
            spot = _spots(h1[left], h2[left], len(sizes), size * 64)
            alone = np.bincount(spot, minlength=size * 64)[spot] == 1
            bits = np.zeros(size * 64, np.uint8)
            bits[spot[alone]] = 1
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or the slot of another key, for keys that were not built in."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            spot = _spots(h1[left], h2[left], level, size * 64)
            word, bit = self.words[base + (spot >> 6)], (spot & 63).astype(_U)
            hit = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[hit]] = (self.before[base + (spot >> 6)] + below)[hit]
            left, base = left[~hit], base + size
        return out
