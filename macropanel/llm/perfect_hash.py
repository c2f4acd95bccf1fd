"""A minimal perfect hash over 64-bit keys: level bitmaps with rank counts.

Keys that meet no other key at their place of level 0 stay there; the rest go on to level 1 with
another hash, and so on. A key's slot is its rank among all set bits, so n keys fill the slots
0 to n - 1. Keys outside the set may get a slot as well or none (-1): the caller compares what
the slot holds.
"""

from __future__ import annotations

import numpy as np

from .common import mix

GAMMA = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """`slots(keys)` of the distinct `keys` it was built from are a permutation of 0 to n - 1."""

    def __init__(self, keys: np.ndarray):
        rest = np.asarray(keys, np.uint64)
        if len(np.unique(rest)) != len(rest):
            raise ValueError("the keys of a perfect hash must be distinct")
        self.sizes: list[int] = []
        maps = []
        while len(rest):
            size = GAMMA * len(rest)
            at = self._places(rest, len(self.sizes), size)
            counts = np.bincount(at, minlength=size)
            alone = counts == 1
            self.sizes.append(size)
            maps.append(alone)
            rest = rest[~alone[at]]
        self.bits = np.concatenate(maps) if maps else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(((level + 1) * int(_STEP)) % 2**64)
        return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self._places(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += size
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.sizes), *self.sizes], "<i8")
        return sizes.tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        made = cls(np.zeros(0, np.uint64))
        levels = int(np.frombuffer(data, "<i8", 1)[0])
        made.sizes = np.frombuffer(data, "<i8", levels, 8).tolist()
        packed = np.frombuffer(data, np.uint8, offset=8 + 8 * levels)
        made.bits = np.unpackbits(packed, count=sum(made.sizes)).astype(bool)
        made.rank = np.cumsum(made.bits, dtype=np.int64) - 1
        return made
