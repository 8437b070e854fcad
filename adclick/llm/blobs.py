"""Sorted integers as small binary values, to travel through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned 32-bit integers: gaps, by byte plane, compressed."""
    gaps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def at_most_twice(values: np.ndarray) -> np.ndarray:
    """Sorted, and every value twice at most."""
    values = np.sort(values)
    return values if len(values) < 3 else values[np.r_[True, True, values[2:] != values[:-2]]]


def twice(values: np.ndarray) -> np.ndarray:
    """The distinct values that occur twice or more."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


class Pairs:
    """128-bit keys as two unsigned 64-bit columns, in ascending order."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        order = np.lexsort((low, high))
        self.high, self.low = high[order], low[order]

    def __len__(self) -> int:
        return len(self.high)

    def _same_as(self, back: int) -> np.ndarray:
        """Whether each key equals the one ``back`` places before it."""
        same = np.zeros(len(self), bool)
        same[back:] = (self.high[back:] == self.high[: len(self) - back]) & (self.low[back:] == self.low[: len(self) - back])
        return same

    def take(self, which: np.ndarray) -> Pairs:
        out = object.__new__(Pairs)
        out.high, out.low = self.high[which], self.low[which]
        return out

    def at_most_twice(self) -> Pairs:
        return self.take(~self._same_as(2))

    def distinct(self) -> Pairs:
        return self.take(~self._same_as(1))

    def repeated(self) -> Pairs:
        return self.take(self._same_as(1)).distinct()

    def holds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.zeros(len(high), bool)
        if not len(self):
            return found
        at = np.searchsorted(self.high, high)
        open_ = np.arange(len(high))
        while len(open_):  # once, unless two keys share their first half
            open_ = open_[at[open_] < len(self)]
            open_ = open_[self.high[at[open_]] == high[open_]]
            hit = self.low[at[open_]] == low[open_]
            found[open_[hit]] = True
            open_ = open_[~hit]
            at[open_] += 1
        return found

    def to_bytes(self) -> bytes:
        return np.stack([self.high, self.low]).tobytes()

    @staticmethod
    def parts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.frombuffer(blob, np.uint64).reshape(2, -1)
        return high, low

    @staticmethod
    def gather(blobs: list[bytes]) -> Pairs:
        both = [Pairs.parts(b) for b in blobs]
        none = np.zeros(0, np.uint64)
        return Pairs(np.concatenate([none, *(h for h, _ in both)]), np.concatenate([none, *(x for _, x in both)]))
