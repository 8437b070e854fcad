"""Restoring disguised words by a noisy channel.

A stretch of text that may be disguised (look-alike digits and signs in a word
with letters, letters drawn apart, letters repeated three times or more) becomes
a lattice: each sign may stand for one of a few letters or for itself, a gap may
be nothing or a gap, a run of one letter may be one or two. Numbers apart from
letters and marks after a word are cheap to keep. The path that is
likeliest under a trigram model of characters times the cost of its disguises
is found by Viterbi search. All other text has one path only and stays as it is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from adclick.llm.words import NOT_SPACE, scan

# What a sign is read as.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
GAPS = " .-_"

# Log-costs of a disguise.
_READ, _KEEP, _JOIN, _GAP, _DOUBLE, _ONCE, _MARK = -0.7, -6.0, -0.3, -1.0, -0.7, -4.0, -1.0

_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])", re.ASCII)
_TAIL = re.compile(r"(?<=[^\s!*|(+$@])[!*|(+$@]+(?=[^\w\s]*(?:\s|$))")

SYMBOLS = 28  # 0 no letter, 1-26 letters, 27 letters above ASCII


def _symbols() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[65:91] = out[97:123] = np.arange(1, 27)
    out[0xC0:] = 27
    return out


SYMBOL_OF = _symbols()
_SIGNS = np.array([ord(c) for c in LOOKS])
_GAPS = np.array([ord(c) for c in GAPS[1:]])

# Decodings a worker remembers before it starts anew.
CACHE = 200_000


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of three symbols in a row; runs of no letter are one."""
    symbols = SYMBOL_OF[data[(data & 0xC0) != 0x80]].astype(np.int32)
    symbols = np.concatenate([[0], symbols, [0]])
    symbols = symbols[np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])]
    code = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    return np.bincount(code, minlength=SYMBOLS**3)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed with the shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def _keep_costs(text: str) -> dict[int, float]:
    """What it costs to keep the signs at some places: one disguise for a number
    apart from letters, little for marks that usually follow a word."""
    out = {}
    for number in _NUMBER.finditer(text):
        runs = [m.start() for m in re.finditer(r"(.)\1*", number[0])]
        out |= {number.start() + k: _KEEP / len(runs) for k in runs}
    for tail in _TAIL.finditer(text):
        for run in re.finditer(r"(.)\1*", tail[0]):
            if run[1] in "!*|(+" or len(run[0]) >= 3:
                out[tail.start() + run.start()] = _MARK
    return out


def _lattice(text: str) -> list[list[tuple[str, float]]]:
    out, kept = [], _keep_costs(text)
    for run in re.finditer(r"(.)\1*", text, re.DOTALL):
        sign, n = run[1], len(run[0])
        if sign in GAPS or sign.isspace():
            out.append([("", _JOIN), (" ", _GAP)])
        elif sign in LOOKS:
            keep, reads = (sign * n, kept.get(run.start(), _KEEP)), LOOKS[sign]
            if n == 1:
                out.append([(c, _READ) for c in reads] + [keep])
            elif n == 2:  # two letters rather than one drawn out
                out.append([(c + d, _READ + _DOUBLE) for c in reads for d in reads] + [(c, _READ + _ONCE) for c in reads] + [keep])
            else:
                out.append([(c, _READ) for c in reads] + [keep] + [(c * 2, _READ + _DOUBLE) for c in reads])
        elif n >= 3:
            out.append([(sign, 0.0), (sign * 2, _DOUBLE)])
        else:
            out.extend([[(sign, 0.0)]] * n)
    return out


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.cache: dict[str, str] = {}

    def decode(self, text: str) -> str:
        """The likeliest reading of a stretch; ties go to the earlier choice."""
        found = self.cache.get(text)
        if found is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.cache[text] = self._search(text)
        return found

    def _search(self, text: str) -> str:
        best = {(0, 0): (0.0, None)}  # state: score, back-pointer
        for choices in _lattice(text) + [[(" ", 0.0)]]:
            step: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, path) in best.items():
                for emitted, cost in choices:
                    x, y, total = a, b, score + cost
                    for c in emitted:
                        z = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                        if z or y:
                            total += self.model[x][y][z]
                            x, y = y, z
                    if (x, y) not in step or total > step[x, y][0]:
                        step[x, y] = (total, (path, emitted))
            best = step
        _, path = max(best.values(), key=lambda v: v[0])
        out = []
        while path is not None:
            path, emitted = path
            out.append(emitted)
        return "".join(reversed(out)).rstrip(" ")

    def restore(self, column: pa.Array) -> pa.Array:
        """The texts in which disguised stretches are put right."""
        words = scan(column, NOT_SPACE)
        low, high, row = stretches(words)
        if not len(low):
            return column
        texts = column.to_pylist()
        blob = words.data.tobytes()
        bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        low, high, offsets = low.tolist(), high.tolist(), words.offsets.tolist()
        for i in range(len(texts)):
            if bounds[i] == bounds[i + 1]:
                continue
            out, at = [], offsets[i]
            for k in range(bounds[i], bounds[i + 1]):
                out.append(blob[at : low[k]])
                out.append(self.decode(blob[low[k] : high[k]].decode().lower()).encode())
                at = high[k]
            out.append(blob[at : offsets[i + 1]])
            texts[i] = b"".join(out).decode()
        return pa.array(texts, pa.string())


def _folded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case."""
    kinds, place = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    lower = np.array([ord(chr(c).lower()[0]) for c in kinds.tolist()], np.int32)
    return letter[place], lower[place]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each code point, and the code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return at, np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)


def stretches(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans that may be disguised, and the text each is in: words with
    letters and signs, with a letter three times in a row or with two gaps in
    them, and three or more single letters or signs in a row."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return starts, ends, starts
    at, codes = _code_points(data)
    first, after = np.searchsorted(at, starts), np.searchsorted(at, ends)
    letter, folded = _folded(codes)
    sign, gap = np.isin(codes, _SIGNS), np.isin(codes, _GAPS)
    word = np.zeros(len(codes) + 1, np.int64)  # the word of each code point, or -1
    word[first] += 1
    total = np.cumsum(word)
    inside = np.zeros(len(codes) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, after, -1)
    word = np.where(np.cumsum(inside) > 0, total - 1, -1)[:-1]

    def count(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[after] - total[first]

    letters = count(letter)
    flagged = (letters > 0) & (count(sign) > 0)
    triple = np.flatnonzero((folded[:-2] == folded[1:-1]) & (folded[1:-1] == folded[2:]) & letter[:-2] & (word[:-2] == word[2:]))
    flagged[word[triple]] = True
    begins = np.flatnonzero(gap & ~np.concatenate([[False], gap[:-1]]))
    closes = np.flatnonzero(gap & ~np.concatenate([gap[1:], [False]]))
    whole = (begins > 0) & (closes < len(codes) - 1)
    before, behind = begins[whole] - 1, closes[whole] + 1
    drawn = (letter | sign)[before] & (letter | sign)[behind] & (word[before] == word[behind])
    flagged |= (np.bincount(word[before[drawn]], minlength=len(starts)) >= 2) & (letters > 0)
    lone = (after - first == 1) & (letter | sign)[first]
    row = words.text_of()
    joined = lone[1:] & lone[:-1] & (row[1:] == row[:-1])  # one run with the word before
    run = np.concatenate([[0], np.cumsum(~joined)])
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    last = np.append(head[1:], len(starts)) - 1
    long = lone[head] & (last - head >= 2)
    flagged |= long[run]
    keep = flagged[head] | long
    return starts[head[keep]], ends[last[keep]], row[head[keep]]
