"""A hash table for arrays of keys."""

from __future__ import annotations

import numpy as np


class Table:
    """int64 keys to int values, looked up by arrays; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # each round, the first claimant of every free slot settles
            free = self.keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            k, held = keys[left], self.keys[slot]
            hit = held == k
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (held != -1)
            left, slot = left[more], slot[more]
        return out

    def items(self) -> dict[int, int]:
        """All of it as a dict."""
        there = self.keys != -1
        return dict(zip(self.keys[there].tolist(), self.values[there].tolist(), strict=True))
