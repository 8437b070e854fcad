"""Hard negatives by exact integer products of anchor and candidate tiles.

The anchors are the stated query set. Rows are packed into tiles where they
are, without a shuffle; anchors into blocks. Tiles and blocks meet in a grid: a
tile goes to one of the columns, once for each block, a block to all columns.
There are as many columns as shuffle partitions, or more, so that a column holds
``TILES`` full tiles on average. A task multiplies a block by the tiles of its
column, one after the other, so its memory follows these sizes, not the table's.
No row is paired with another outside these products.

A product is Strassen's recursion on int64 matrices padded with zeros. Sums and
products are exact modulo 2**64, so scores are exact wherever they fit a long.

1. Each task keeps for every anchor of its block the best rows of its label;
   these heaps are merged in a tree, the square root of all columns at a time.
2. The merged positives give each anchor its windows of scores. A second pass
   over the same products keeps the best rows of other labels in each window,
   merged the same way.

Heaps hold the highest scores, ties by smaller id. Rows with a null id, label
or vector and rows with a component that is null or not finite take no part.
Vectors of several lengths are padded with zeros. Rows are named by their ids:
a row is no positive of an anchor with its own id, and rows of equal id and
score fill one place of a heap. Equal anchor rows are one anchor; of several
rows with one id each is an anchor. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.sources.scratch import materialise

# Rows of a tile and of a block; a task holds a few tables of TILE * BLOCK longs.
TILE = 4096
BLOCK = 1024
# Full tiles of a column of the grid, on average.
TILES = 16
# Strassen's recursion stops at sides of this length or shorter.
LEAF = 32

_PACKED = "rows int, width int, kind string, ids binary, labels binary, vectors binary"
_LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64, by seven products of
    halves; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    out = np.empty((2 * i, 2 * h), np.int64)
    top, bottom = out[:i], out[i:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    top[:, h:] = p3
    bottom[:, :h] = p2
    bottom[:, h:] = p1 + p3
    bottom[:, h:] -= p2
    bottom[:, :h] += p4
    top[:, :h] = p1 + p4
    p5 = strassen(a11 + a12, b22, leaf)
    top[:, h:] += p5
    top[:, :h] -= p5
    bottom[:, h:] += strassen(a21 - a11, b11 + b12, leaf)
    top[:, :h] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


class Heaps(NamedTuple):
    """For each of many owners its best entries, best first; places that are
    not filled come last."""

    filled: np.ndarray  # owners x size
    scores: np.ndarray
    ids: np.ndarray

    @staticmethod
    def ordered(filled: np.ndarray, scores: np.ndarray, ids: np.ndarray, size: int) -> Heaps:
        """The best ``size`` of each row's entries, one of equal ones."""

        def sort() -> list[np.ndarray]:
            # ~x falls as x grows, without an overflow at the lowest number
            order = np.lexsort((ids, ~scores, ~filled), axis=1)
            return [np.take_along_axis(x, order, axis=1) for x in (filled, scores, ids)]

        filled, scores, ids = sort()
        again = np.zeros(filled.shape, bool)
        again[:, 1:] = filled[:, 1:] & (scores[:, 1:] == scores[:, :-1]) & (ids[:, 1:] == ids[:, :-1])
        if again.any():
            filled = filled & ~again
            filled, scores, ids = sort()
        return Heaps(filled[:, :size], scores[:, :size], ids[:, :size])

    @staticmethod
    def empty(owners: int) -> Heaps:
        return Heaps(np.zeros((owners, 0), bool), np.zeros((owners, 0), np.int64), np.zeros((owners, 0), np.int64))

    def merge(self, other: Heaps, size: int) -> Heaps:
        return Heaps.ordered(*(np.concatenate([x, y], axis=1) for x, y in zip(self, other, strict=True)), size)

    @staticmethod
    def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, size: int) -> Heaps:
        """Of a table of scores the best allowed columns of each row; ``ids`` of
        the columns ascend, so the first of equal scores is the one to take.
        Equal ids with equal scores must have been left out."""
        owners, columns = scores.shape
        size = min(size, columns)
        if not size:
            return Heaps.empty(owners)
        values = np.where(allowed, scores, _LOWEST)
        bound = np.partition(values, columns - size, axis=1)[:, columns - size, None]
        above = values > bound
        level = values == bound
        room = size - above.sum(axis=1, keepdims=True)
        row, column = np.nonzero(above | (level & allowed & (np.cumsum(level & allowed, axis=1) <= room)))
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(owners))[row]
        out = Heaps(np.zeros((owners, size), bool), np.zeros((owners, size), np.int64), np.zeros((owners, size), np.int64))
        out.filled[row, place] = True
        out.scores[row, place] = values[row, column]
        out.ids[row, place] = ids[column]
        return Heaps.ordered(*out, size)

    def to_row(self) -> dict:
        return {"size": self.filled.shape[1], "filled": self.filled.tobytes(), "scores": self.scores.tobytes(), "names": self.ids.tobytes()}

    @staticmethod
    def of_row(row: dict) -> Heaps:
        parts = (np.frombuffer(row[n], t) for n, t in (("filled", bool), ("scores", np.int64), ("names", np.int64)))
        size = row["size"]
        return Heaps(*(x.reshape(-1, size) if size else x.reshape(0, 0) for x in parts))


_HEAPS = "block int, part int, size int, filled binary, scores binary, names binary"


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def to_row(self) -> dict:
        ends = int(self.vectors.min(initial=0)), int(self.vectors.max(initial=0))
        kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= ends[0] and ends[1] <= np.iinfo(k).max)
        return {
            "rows": len(self.ids), "width": self.vectors.shape[1], "kind": kind, "ids": self.ids.tobytes(),
            "labels": self.labels.tobytes(), "vectors": self.vectors.astype(kind).tobytes(),
        }

    @staticmethod
    def of_row(row: dict) -> Rows:
        vectors = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64).reshape(row["rows"], row["width"])
        return Rows(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors)

    @staticmethod
    def of_batch(batch: pa.RecordBatch | pa.Table, scale: float) -> Rows:
        """Whole numbers of vectors times ``scale``, by ascending id."""
        vectors = batch.column("vector")
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if len(flat) and np.abs(flat).max() >= 2.0**62:
            flat = np.fmod(flat, 2.0**64)
            whole = np.where(flat >= 2.0**63, flat - 2.0**64, np.where(flat < -(2.0**63), flat + 2.0**64, flat)).astype(np.int64)
        else:
            whole = flat.astype(np.int64)
        width = int(lengths.max(initial=0))
        table = np.zeros((len(lengths), width), np.int64)
        table[np.arange(width) < lengths[:, None]] = whole
        ids, labels = (batch.column(n).to_numpy().astype(np.int64) for n in ("id", "label"))
        order = np.argsort(ids, kind="stable")
        return Rows(ids[order], labels[order], table[order])

    def products(self, others: Rows) -> np.ndarray:
        width = max(self.vectors.shape[1], others.vectors.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.vectors, others.vectors))
        return strassen(a, np.ascontiguousarray(b.T))

    def repeats(self, scores: np.ndarray) -> np.ndarray:
        """Where a column has the score and the id of one before it, as a table
        that broadcasts. Ids ascend, so equal ones are neighbours."""
        same = self.ids[1:] == self.ids[:-1]
        if not same.any():
            return np.zeros((1, len(self.ids)), bool)
        again = np.zeros(scores.shape, bool)
        bounds = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low > 1:
                order = np.argsort(scores[:, low:high], axis=1, kind="stable")
                own = np.take_along_axis(scores[:, low:high], order, axis=1)
                equal = np.zeros(own.shape, bool)
                equal[:, 1:] = own[:, 1:] == own[:, :-1]
                np.put_along_axis(again[:, low:high], order, equal, axis=1)
        return again


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: list[dict], schema: str) -> pa.Table:
    fields = (field.split() for field in schema.split(", "))
    return pa.Table.from_pylist(rows, pa.schema([(name, _KINDS[kind]) for name, kind in fields]))


def _tiler(scale: float, columns: int):
    """Pack the rows of a partition into tiles, in the order they come."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TILE):
                rows = Rows.of_batch(batch.slice(low, TILE), scale)
                number = int((rows.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) >> np.uint64(24))
                row = {"part": number % columns, **rows.to_row()}
                yield from _table([row], f"part int, {_PACKED}").to_batches()

    return tiles


def _packer(scale: float):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return _table([{"block": key[0].as_py(), **Rows.of_batch(table, scale).to_row()}], f"block int, {_PACKED}")

    return pack


def _positives(size: int):
    """A task's best rows of the anchors' labels."""

    def find(key: tuple, tiles: pa.Table, block: pa.Table) -> pa.Table:
        if not tiles.num_rows or not block.num_rows:
            return _table([], _HEAPS)
        anchors = Rows.of_row(block.to_pylist()[0])
        heaps = Heaps.empty(len(anchors.ids))
        for k in range(tiles.num_rows):
            tile = Rows.of_row(tiles.slice(k, 1).to_pylist()[0])
            scores = anchors.products(tile)
            allowed = (anchors.labels[:, None] == tile.labels) & (anchors.ids[:, None] != tile.ids) & ~tile.repeats(scores)
            heaps = heaps.merge(Heaps.best(scores, allowed, tile.ids, size), size)
        return _table([{"block": key[0].as_py(), "part": key[1].as_py(), **heaps.to_row()}], _HEAPS)

    return find


def _at_least(scores: np.ndarray, percent: int, positive: np.ndarray) -> np.ndarray:
    """100 * score >= percent * positive without an overflow."""
    whole, rest = np.divmod(positive, 100)
    # percent * positive / 100 rounded up, from whole hundreds and the rest
    return scores >= percent * whole - (-percent * rest) // 100


def _at_most(scores: np.ndarray, percent: int, positive: np.ndarray) -> np.ndarray:
    whole, rest = np.divmod(positive, 100)
    return scores <= percent * whole + (percent * rest) // 100


def _negatives(size: int, low: int, high: int):
    """A task's best rows of other labels in the window of each positive; the
    owners of heaps are the places of the anchors' positives in turn."""

    def find(key: tuple, tiles: pa.Table, block: pa.Table) -> pa.Table:
        if not tiles.num_rows or not block.num_rows:
            return _table([], _HEAPS)
        row = block.to_pylist()[0]
        anchors, positives = Rows.of_row(row), Heaps.of_row(row)
        places = positives.filled.shape[1]
        all_heaps = [Heaps.empty(len(anchors.ids)) for _ in range(places)]
        for k in range(tiles.num_rows):
            tile = Rows.of_row(tiles.slice(k, 1).to_pylist()[0])
            scores = anchors.products(tile)
            other = (anchors.labels[:, None] != tile.labels) & ~tile.repeats(scores)
            for place in range(places):
                bound = positives.scores[:, place, None]
                allowed = other & positives.filled[:, place, None] & _at_least(scores, low, bound) & _at_most(scores, high, bound)
                all_heaps[place] = all_heaps[place].merge(Heaps.best(scores, allowed, tile.ids, size), size)
        wide = max((h.filled.shape[1] for h in all_heaps), default=0)
        padded = [[np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in h] for h in all_heaps]
        heaps = Heaps(*(np.stack(x, axis=1).reshape(-1, wide) for x in zip(*padded, strict=True))) if places else Heaps.empty(0)
        return _table([{"block": key[0].as_py(), "part": key[1].as_py(), **heaps.to_row()}], _HEAPS)

    return find


def _merger(size: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        heaps = None
        for k in range(table.num_rows):
            own = Heaps.of_row(table.slice(k, 1).to_pylist()[0])
            heaps = own if heaps is None else heaps.merge(own, size)
        return _table([{"block": key[0].as_py(), "part": 0, **heaps.to_row()}], _HEAPS)

    return merge


def _merged(heaps: DataFrame, size: int, columns: int) -> DataFrame:
    """One row of heaps for each block, in two levels."""
    branch = F.pmod("part", F.lit(isqrt(columns) + 1)).alias("branch")
    once = heaps.groupBy("block", branch).applyInArrow(_merger(size), _HEAPS)
    return once.groupBy("block").applyInArrow(_merger(size), _HEAPS)


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _listing(key: tuple, block: pa.Table, found: pa.Table) -> pa.Table:
    if not block.num_rows or not found.num_rows:
        return _table([], _RESULT)
    row = block.to_pylist()[0]
    anchors, positives, negatives = Rows.of_row(row), Heaps.of_row(row), Heaps.of_row(found.to_pylist()[0])
    owner, rank = np.nonzero(negatives.filled)
    places = max(1, positives.filled.shape[1])
    anchor, place = owner // places, owner % places
    values = (
        anchors.ids[anchor], positives.ids[anchor, place], rank + 1, negatives.ids[owner, rank],
        positives.scores[anchor, place], negatives.scores[owner, rank],
    )
    return pa.table(dict(zip(_table([], _RESULT).column_names, values, strict=True))).cast(_table([], _RESULT).schema)


def mine_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor and each of its best rows of the same label
    the best rows of other labels that score from ``low`` to ``high`` percent of
    what the positive scores. Ids and labels are whole numbers.
    """
    spark = df.sparkSession
    number = F.col(vector).cast("array<double>")
    sound = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))
    rows = df.where(part).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), number.alias("vector"), is_anchor.alias("anchor")
    )
    total, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    columns = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (TILE * TILES)))
    n_blocks = max(1, -(-n_anchors // BLOCK))
    chosen = rows.where("anchor").select("id", "label", "vector").distinct()
    block = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = chosen.withColumn("block", block).groupBy("block").applyInArrow(_packer(scale), f"block int, {_PACKED}")
    blocks = materialise(blocks, "blocks")
    tiles = rows.select("id", "label", "vector").mapInArrow(_tiler(scale, columns), f"part int, {_PACKED}")
    tiles = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("block", "part")

    def dealt(to_all: DataFrame) -> DataFrame:
        return to_all.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).groupBy("block", "part")

    best = _merged(tiles.cogroup(dealt(blocks)).applyInArrow(_positives(positives), _HEAPS), positives, columns)
    known = materialise(blocks.join(best.drop("part"), "block"), "positives")
    found = tiles.cogroup(dealt(known)).applyInArrow(_negatives(negatives, low, high), _HEAPS)
    found = _merged(found, negatives, columns)
    return known.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_listing, _RESULT)
