"""Repeated word windows: a count-min prefilter, then exact counts of the rest.

1. Documents are dealt into buckets by their row numbers, so equal ones are
   spread, too. Every bucket makes a partial count-min sketch of its windows (``DEPTH`` rows, split into shards by the
   window hash) and sends each shard its occupied cells only, packed.
2. A shard merges the partial sketches of all buckets and answers each bucket
   with those of its cells that counted two or more. A sketch only
   overestimates, so no repeated window is missed.
3. A bucket keeps the windows whose cells are full in every row and sends
   their 128-bit keys, each once or twice, to a shard that counts them exactly.
4. The bucket gets its repeated keys back and removes the covered words.

A window that a third of all documents hold is sent once or twice by each
bucket, so no shard gets more rows of it than there are buckets. A task holds
one bucket's documents or one shard's cells. There are as many buckets as make
``BUCKET_BYTES`` of text each, shards as make ``SHARD_BYTES``, and no fewer than
follow from ``spark.sql.shuffle.partitions``. The text is shuffled once, as
the three uses share one exchange. Lost executors cost a rerun of tasks; the
row numbers are the same again if the input is read in a fixed order, as files
and written tables are.

Null and empty texts have no words. Repeated rows repeat each other's windows.
A text shorter than the window has none. Other columns pass through, whatever
their names, except that the three result columns replace older ones of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.blobs import Pairs, at_most_twice, member, pack, twice, unpack
from adclick.llm.tables import free_name
from adclick.llm.words import NOT_SPACE, Words, chunks, scan, whole_windows, window_hashes

WINDOW = 35
DEPTH = 2  # rows of the sketch
CELL_BITS = 26  # cells of one row of one shard, as a power of two
BUCKETS = 2  # for each shard at least, so that a task holds half as many documents
BUCKET_BYTES = 64_000_000  # of text
SHARD_BYTES = 512_000_000

_MESSAGE = "__to int, __from int, __row int, __blob binary"


def bucket_of(key: str | None, buckets: int) -> Column:
    """A bucket by the number of a row; hashed, as numbers of a task follow each other."""
    parts = [F.monotonically_increasing_id(), *([] if key is None else [F.col(key)])]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def sizes(df: DataFrame, text: str, shards: int | None = None) -> tuple[int, int]:
    """Shards and buckets for the bytes of all texts."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = shards or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    return shards, max(BUCKETS * shards, -(-total // BUCKET_BYTES))


def _pieces(table: pa.Table, text: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for piece in chunks(table.to_batches(), text):
        yield piece, scan(piece.column(text), NOT_SPACE)


def _cells(first: np.ndarray, second: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of windows with these hash halves: their shards and their cells in each row."""
    shard = (first >> np.uint64(40)) % np.uint64(shards)
    mask = np.uint64(2**CELL_BITS - 1)
    return shard.astype(np.int32), [(h & mask).astype(np.uint32) for h in (first, second)][:DEPTH]


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of a piece's windows, and both halves of their hashes."""
    at = whole_windows(words, size)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return at, *(window_hashes(words.hashes(half), size, half)[at] for half in (0, 1))


def _by_shard(shard: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    shard, values = shard[order], values[order]
    bounds = np.flatnonzero(np.diff(shard, prepend=-1))
    for low, high in zip(bounds, np.append(bounds[1:], len(shard)), strict=True):
        yield int(shard[low]), values[low:high]


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    to, of, row, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table(
        {
            "__to": pa.array(to, pa.int32()),
            "__from": pa.array(of, pa.int32()),
            "__row": pa.array(row, pa.int32()),
            "__blob": pa.array(blob, pa.binary()),
        }
    )


def _sketch(text: str, size: int, shards: int):
    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        bucket, parts = key[0].as_py(), []
        for _, words in _pieces(table, text):
            _, first, second = _windows(words, size)
            parts.append(_cells(first, second, shards))
        shard = np.concatenate([s for s, _ in parts])
        return _messages(
            [
                (to, bucket, row, pack(at_most_twice(cells)))
                for row in range(DEPTH)
                for to, cells in _by_shard(shard, np.concatenate([c[row] for _, c in parts]))
            ]
        )

    return sketch


def _merge(table: pa.Table) -> pa.Table:
    """Merge a shard's partial sketches; to each bucket, those of its cells that
    count two or more."""
    to, of, row, blob = (table.column(c).to_pylist() for c in ("__to", "__from", "__row", "__blob"))
    out = []
    for r in sorted(set(row)):
        cells = {of[i]: unpack(blob[i]) for i in range(len(of)) if row[i] == r}
        full = twice(np.concatenate(list(cells.values())))
        for bucket, own in cells.items():
            own = np.unique(own[member(own, full)])
            if len(own):
                out.append((bucket, to[0], r, pack(own)))
    return _messages(out)


def _suspects(text: str, size: int, shards: int):
    """The keys of a bucket's windows that the sketch counts twice or more."""

    def suspects(key: tuple, table: pa.Table, full: pa.Table) -> pa.Table:
        if not table.num_rows or not full.num_rows:
            return _messages([])
        bucket = key[0].as_py()
        wide = [[np.zeros(0, np.uint64)] for _ in range(DEPTH)]
        for of, row, blob in zip(*(full.column(c).to_pylist() for c in ("__from", "__row", "__blob")), strict=True):
            wide[row].append((np.uint64(of) << np.uint64(CELL_BITS)) | unpack(blob).astype(np.uint64))
        ordered = [np.sort(np.concatenate(x)) for x in wide]
        found = []
        for _, words in _pieces(table, text):
            _, first, second = _windows(words, size)
            shard, cells = _cells(first, second, shards)
            high = shard.astype(np.uint64) << np.uint64(CELL_BITS)
            likely = np.ones(len(first), bool)
            for row, cell in enumerate(cells):
                likely &= member(high | cell.astype(np.uint64), ordered[row])
            found.append((first[likely], second[likely]))
        keys = Pairs(*map(np.concatenate, zip(*found, strict=True))).at_most_twice()
        shard, _ = _cells(keys.high, keys.low, shards)
        return _messages(
            [(to, bucket, 0, keys.take(own).to_bytes()) for to, own in _by_shard(shard, np.arange(len(keys)))]
        )

    return suspects


def _count(table: pa.Table) -> pa.Table:
    """Count a shard's keys exactly; to each bucket, its repeated ones."""
    to, of, blob = (table.column(c).to_pylist() for c in ("__to", "__from", "__blob"))
    repeated = Pairs.gather(blob).repeated()
    out = []
    for bucket, own in zip(of, blob, strict=True):
        keys = Pairs(*Pairs.parts(own)).distinct()
        keys = keys.take(repeated.holds(keys.high, keys.low))
        if len(keys):
            out.append((bucket, to[0], 0, keys.to_bytes()))
    return _messages(out)


def _removal(text: str, size: int, schema: pa.Schema):
    def remove(table: pa.Table, repeated: pa.Table) -> pa.Table:
        keys = Pairs.gather(repeated.column("__blob").to_pylist())
        out = []
        for piece, words in _pieces(table, text):
            at, first, second = _windows(words, size)
            at = at[keys.holds(first, second)]
            turns = np.zeros(len(words.starts) + 1, np.int64)
            turns[at] += 1
            np.subtract.at(turns, at + size, 1)
            out.append(_kept(piece, words, np.cumsum(turns[:-1]) > 0, text, schema))
        return pa.Table.from_batches(out, schema)

    return remove


def _kept(piece: pa.RecordBatch, words: Words, removed: np.ndarray, text: str, schema: pa.Schema) -> pa.RecordBatch:
    gone = np.concatenate([[0], np.cumsum(removed)])
    n_removed = gone[words.first[1:]] - gone[words.first[:-1]]
    texts = []
    for i in range(piece.num_rows):
        # split() of bytes cuts at the six separators of the word class
        own = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
        if n_removed[i]:
            own = compress(own, (~removed[words.first[i] : words.first[i + 1]]).tolist())
        texts.append(b" ".join(own).decode())
    values = {
        "n_words": pa.array(words.counts(), pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "kept_text": pa.array(texts, pa.string()),
    }
    columns = [values[f.name] if f.name in values else piece.column(f.name).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def remove_repeated(
    df: DataFrame, text: str = "text", key: str | None = None, size: int = WINDOW, shards: int | None = None
) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text``: its words that
    no window of ``size`` words found elsewhere covers, joined by one space.

    ``key`` names a column that may take part in dealing rows into buckets.
    """
    df = df.drop("n_words", "n_removed", "kept_text")
    shards, buckets = sizes(df, text, shards)
    bucket = free_name(df, "__bucket")
    base = df.withColumn(bucket, bucket_of(key, buckets)).repartition(buckets, bucket)
    by_bucket = base.groupBy(bucket)
    full = (
        by_bucket.applyInArrow(_sketch(text, size, shards), _MESSAGE)
        .groupBy("__to").applyInArrow(_merge, _MESSAGE)
    )
    repeated = (
        by_bucket.cogroup(full.groupBy("__to")).applyInArrow(_suspects(text, size, shards), _MESSAGE)
        .groupBy("__to").applyInArrow(_count, _MESSAGE)
    )
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    result = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    return by_bucket.cogroup(repeated.groupBy("__to")).applyInArrow(
        _removal(text, size, to_arrow_schema(result)), result
    )
