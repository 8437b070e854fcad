"""Periodic runs of words, by the longest common extensions of suffix trees.

A run is a stretch of words with smallest period q (words q apart are
identical), at least twice as long as q, that no neighbouring word extends.

1. Within a run every word lies in a window of ``least // 2`` words that the run
   holds twice. Stretches of a text that no repeated window covers hold no run
   and are cut out; what is left is looked at again within each stretch.
2. Ukkonen's algorithm builds a suffix tree of the stretches, with a mark of
   its own after each, and one of their reversal. A tour of a tree gives the
   order of its suffixes and, between each two, the least string depth that the
   tour passes: the depth of their lowest common ancestor. A sparse table over
   these depths answers how far two places agree in constant time.
3. The longest Lyndon word at a place ends where the next smaller suffix starts.
   The root of every run is such a word in one of the two orders of the
   alphabet (the order of suffixes and its reverse), so these words are all
   candidates there are. Each is extended forward by one tree and backward by
   the other; those long enough are runs, and roots name the smallest period.

A tree spans the stretches of the documents of one piece of a batch; marks keep
documents apart. Rows stay where they are: there is no shuffle. A text that is
longer than a piece is a piece alone, and its memory grows with its repeated
part (about 1 kB a word). Words are told apart by 64 bits of hash within a piece.

Null and empty texts have no words and no runs; repeated rows get equal results;
result columns replace older ones of the same name, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.words import NOT_SPACE, Words, chunks, mix, scan, whole_windows, window_hashes

LEAST = 12


class SuffixTree:
    """Ukkonen's tree of a list of symbols; 0 must be its last one and no other."""

    def __init__(self, symbols: list[int]):
        self.size = len(symbols)
        self.sigma = max(symbols) + 1
        self.start, self.stop, self.leaf = [0], [0], [-1]
        self.edges: dict[int, int] = {}  # parent * sigma + first symbol -> child
        self._build(symbols)

    def _build(self, symbols: list[int]) -> None:
        start, stop, leaf, edges, sigma, size = self.start, self.stop, self.leaf, self.edges, self.sigma, self.size
        link = [0]
        node = at = length = 0  # the active point: a node, and a way along an edge
        pending = 0  # suffixes that are not in the tree on their own yet
        for place, symbol in enumerate(symbols):
            pending += 1
            fresh = 0  # an inner node that waits for its link
            while pending:
                if not length:
                    at = place
                key = node * sigma + symbols[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(place)
                    stop.append(size)
                    leaf.append(place - pending + 1)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = stop[child] - start[child]
                    if length >= span:
                        node, length, at = child, length - span, at + span
                        continue
                    middle = start[child] + length
                    if symbols[middle] == symbol:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(start)
                    edges[key] = inner
                    start += (start[child], place)
                    stop += (middle, size)
                    leaf += (-1, place - pending + 1)
                    link += (0, 0)
                    start[child] = middle
                    edges[inner * sigma + symbols[middle]] = child
                    edges[inner * sigma + symbol] = inner + 1
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = place - pending + 1

    def tour(self) -> tuple[list[int], list[int]]:
        """The suffixes in order, and before each the least string depth that
        the tour has passed since the one before."""
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        order = np.argsort(keys)
        kids = np.fromiter(self.edges.values(), np.int64, len(keys))[order]
        first = np.searchsorted(keys[order] // self.sigma, np.arange(len(self.start) + 1)).tolist()
        kids = kids.tolist()
        start, stop, leaf = self.start, self.stop, self.leaf
        suffixes, lows = [], []
        stack = [(0, 0)]
        low = -1
        while stack:
            node, above = stack.pop()
            if low < 0:
                low = above  # the first step after a suffix starts at the common ancestor
            if leaf[node] >= 0:
                suffixes.append(leaf[node])
                lows.append(low)
                low = -1
            else:
                depth = above + stop[node] - start[node]
                stack += [(kid, depth) for kid in reversed(kids[first[node] : first[node + 1]])]
        return suffixes, lows


class Extensions:
    """How many symbols agree from two places on, in constant time each."""

    def __init__(self, symbols: np.ndarray):
        suffixes, lows = SuffixTree(symbols.tolist()).tour()
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [np.array(lows, np.int32)]
        while 2 ** len(self.table) <= len(lows):
            half, below = 2 ** (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places ``a`` and ``b`` that differ."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - 2**k])
        return out


def next_lower(values: list[int]) -> np.ndarray:
    """For each place the next one with a lower value; the length if there is none."""
    out = [len(values)] * len(values)
    stack: list[int] = []
    for place, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            out[stack.pop()] = place
        stack.append(place)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of positive symbols, of
    ``least`` or more and twice the period, by start, then period."""
    size = len(symbols)
    if size < 2:
        return np.zeros((0, 3), np.int64)
    end = np.zeros(1, symbols.dtype)
    forward = Extensions(np.concatenate([symbols, end]))
    backward = Extensions(np.concatenate([symbols[::-1], end]))
    rank = forward.rank
    place = np.arange(size + 1)
    found = []
    for order in (rank, -rank):
        period = next_lower(order.tolist()) - place
        at = np.flatnonzero(place + period <= size)
        period = period[at]
        # going back from the places before at and at + period
        back = backward(size - at, size - at - period)
        start = at - back
        length = at + period + forward(at, at + period) - start
        good = (length >= least) & (length >= 2 * period)
        found.append(np.stack([start[good], period[good], length[good]], axis=1))
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _stretches(words: Words, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of the stretches that may hold runs."""
    size = max(1, least // 2)
    at = whole_windows(words, size)
    values = window_hashes(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    home = words.text_of()  # what a window must be repeated in
    first = last = np.zeros(0, np.int64)
    before = -1
    while len(at) and len(at) != before:
        before = len(at)
        _, place, count = np.unique(mix(values ^ mix(home[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = count[place] > 1
        at, values = at[twice], values[twice]
        turns = np.zeros(len(home) + 1, np.int64)
        np.add.at(turns, at, 1)
        np.subtract.at(turns, at + size, 1)
        covered = np.cumsum(turns[:-1]) > 0
        # a stretch ends where the next word is in another text, too
        cut = np.zeros(len(home) + 1, bool)
        cut[words.first] = True
        joined = covered[1:] & covered[:-1] & ~cut[1 : len(home)]
        first = np.flatnonzero(covered & ~np.concatenate([[False], joined]))
        last = np.flatnonzero(covered & ~np.concatenate([joined, [False]])) + 1
        long = last - first >= least
        first, last = first[long], last[long]
        home = np.full(len(home), -1)
        for number, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            home[a:b] = number
        inside = home[at] >= 0
        at, values = at[inside], values[inside]
    return first, last


def word_runs(words: Words, least: int = LEAST) -> np.ndarray:
    """(first word, length, period) of all runs of a piece's texts."""
    hashes = words.hashes()
    first, last = _stretches(words, hashes, least)
    if not len(first):
        return np.zeros((0, 3), np.int64)
    lengths = last - first
    # each stretch and, after it, a mark that occurs once
    begin = np.cumsum(lengths + 1) - lengths - 1
    places = np.repeat(first - begin, lengths + 1) + np.arange(int((lengths + 1).sum()))
    is_mark = np.zeros(len(places), bool)
    is_mark[begin + lengths] = True
    symbols = np.empty(len(places), np.int64)
    names, own = np.unique(hashes[places[~is_mark]], return_inverse=True)
    symbols[~is_mark] = own + 1
    symbols[is_mark] = len(names) + 1 + np.arange(len(first))
    runs = runs_of(symbols, least)
    runs[:, 0] = places[runs[:, 0]]
    return runs


_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ADDED = [("n_words", T.LongType()), ("runs", _RUNS), ("collapsed", T.StringType())]


def _collapsed(words: Words, row: int, runs: list[list[int]]) -> str:
    """The words that are in the first period of a run or in none."""
    own = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
    if runs:
        turns = np.zeros(len(own) + 1, np.int64)
        for start, length, period in runs:
            turns[start + period] += 1
            turns[start + length] -= 1
        own = [own[k] for k in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]
    return b" ".join(own).decode()


def _finder(text: str, least: int, schema: pa.Schema):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text):
            words = scan(piece.column(text), NOT_SPACE)
            runs = word_runs(words, least)
            home = np.searchsorted(words.first, runs[:, 0], side="right") - 1
            runs[:, 0] -= words.first[home]
            bounds = np.searchsorted(home, np.arange(piece.num_rows + 1))
            kept = [_collapsed(words, k, runs[bounds[k] : bounds[k + 1]].tolist()) for k in range(piece.num_rows)]
            entries = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(schema.field("runs").type.value_type))
            values = {
                "n_words": pa.array(words.counts(), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries, schema.field("runs").type),
                "collapsed": pa.array(kept, pa.string()),
            }
            columns = [values[f.name] if f.name in values else piece.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return find


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (start, length, period of each run of
    at least ``least`` words, by start, then period) and ``collapsed``: the words
    no run holds after its first period, joined by one space."""
    df = df.drop(*[n for n, _ in _ADDED if n != text])
    result = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in _ADDED]])
    return df.mapInArrow(_finder(text, least, to_arrow_schema(result)), result)
