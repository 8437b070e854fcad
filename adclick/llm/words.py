"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes for which a 256-entry table is true, so every
word class whose members are ASCII or "all above ASCII" can be used. Word and
window hashes are polynomials modulo 2**64 over random byte codes, taken from
running sums, so no Python code runs for a single word. Hashes come as two
independent 64-bit halves where 128 bits are wanted.

Nulls count as empty texts. Texts of any length work; arrays take about 40
bytes for each byte of the longest text or of ``CHUNK_BYTES``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text taken into one set of arrays; a longer text is taken alone.
CHUNK_BYTES = 1_000_000

# A worker runs many stages, and the C library keeps freed arrays below a bound
# that it raises by itself up to 32 MB. Held down, they go back to the system.
_M_MMAP_THRESHOLD = -3
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Everything but space, tab, line feed, vertical tab, form feed and return.
NOT_SPACE = ~np.isin(np.arange(256), _SPACE)
#: ASCII letters and digits and all bytes above ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_codes = np.random.default_rng(20_240_613)
_BYTE_CODE = _codes.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _codes.integers(1, 2**63, size=(2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base = int(base)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._series(self.base, n)
            self.down = self._series(pow(self.base, -1, 2**64), n)
        up, down = self.up[:n], self.down[:n]
        if n > 4 * CHUNK_BYTES:  # not kept for one very long text
            self.up = self.down = np.ones(1, np.uint64)
        return up, down

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_POWERS = [[_Powers(b) for b in row] for row in _BASE]


def _sums(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text each."""
    limit = limit or CHUNK_BYTES
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        first, rows = 0, batch.num_rows
        while first < rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), rows)
            yield batch.slice(first, last - first)
            first = last


class Words(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray  # of texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    first: np.ndarray  # of each text's words; one entry more than texts
    lower: bool

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, half: int = 0) -> np.ndarray:
        code = _BYTE_CODE[half][_LOWER] if self.lower else _BYTE_CODE[half]
        total, down = _sums(code[self.data], _POWERS[half][0])
        value = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(value + (self.ends - self.starts).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def scan(column: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    data, offsets = text_buffers(column)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets[:-1]] = True
    edge[len(data)] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), lower)


def window_hashes(hashes: np.ndarray, size: int, half: int = 0) -> np.ndarray:
    """One hash for each run of ``size`` values, at its first value."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total, down = _sums(hashes, _POWERS[half][1])
    return mix((total[size:] - total[:-size]) * down[: len(hashes) - size + 1])


def whole_windows(words: Words, size: int) -> np.ndarray:
    """First words of the windows that lie within one text."""
    last = np.repeat(words.first[1:] - size, words.counts())
    return np.flatnonzero(np.arange(len(words.starts)) <= last)
