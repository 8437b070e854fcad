"""Benchmark passages in training text, by suffix arrays of the training words.

Each task cuts its documents into shards of whole documents and sorts the
suffixes of a shard: by their first three words at once, packed into one
integer, then only those still tied by the next three, as deep as a window.
Words stand there by 21 bits of their hash; a found match is compared by whole
hashes. Every suffix of every benchmark text is looked up in the shard by
binary search. The run of training suffixes that share the suffix's window
gives all places of it, and the longest match is extended from there.

Documents never move: there is no shuffle. The benchmark is the stated query
set; its distinct rows go to all tasks in blocks of at most ``BLOCK_BYTES`` of
text, one block after the other, a longer text being a block alone. The findings
of several blocks are written down and joined by a digest of the text. A
document longer than a shard is a shard of its own.

Null and empty texts have no words; a benchmark text without words has no
window, and equal benchmark texts are found each under its own id. Null item
ids are found like others but not named. Repeated rows give equal results. Of
several texts or places of one item id the longest match is reported, then the
first in the document, then the first in the item, in however many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.tables import free_name
from adclick.llm.words import ALNUM, chunks, scan
from adclick.sources.scratch import materialise

WINDOW = 10
SHARD_BYTES = 2_000_000
BLOCK_BYTES = 16_000_000
# Parts by hash that blocks are put together from.
FINE = 65_536

_BITS = 21
_LOW = np.uint64(2**_BITS - 1)


def codes_of(hashes: np.ndarray) -> np.ndarray:
    """Small word codes from 1 on; 0 is the end of a text."""
    return np.maximum(hashes & _LOW, np.uint64(1))


def packed(codes: np.ndarray) -> np.ndarray:
    """Three words from each place on, as one integer."""
    wide = np.concatenate([codes, np.zeros(2, np.uint64)])
    return (wide[:-2] << np.uint64(2 * _BITS)) | (wide[1:-1] << np.uint64(_BITS)) | wide[2:]


class SuffixArray:
    """Places of a word sequence in the order of their next ``depth`` words,
    rounded up to threes."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.keys = np.concatenate([packed(codes), np.zeros(depth + 2, np.uint64)])
        order = np.argsort(self.keys[: len(codes)])
        group = np.zeros(len(order), np.int64)  # equal for suffixes still tied
        group[1:] = np.cumsum(self.keys[order[1:]] != self.keys[order[:-1]])
        for done in range(3, depth, 3):
            tied = np.zeros(len(order), bool)
            tied[1:] = group[1:] == group[:-1]
            tied[:-1] |= tied[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            places = order[slots]
            key = self.keys[places + done]
            by = np.lexsort((key, group[slots]))
            places, key = places[by], key[by]
            order[slots] = places
            changed = np.zeros(len(order), bool)
            changed[1:] = group[1:] != group[:-1]
            changed[slots[1:]] |= key[1:] != key[:-1]
            group = np.cumsum(changed)
        self.order = order

    def search(self, keys: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``keys`` (words packed by threes; the masks say how
        many) the run of suffixes that begin with it."""
        return self._bound(keys, masks, False), self._bound(keys, masks, True)

    def _bound(self, keys: np.ndarray, masks: np.ndarray, upper: bool) -> np.ndarray:
        low = np.zeros(len(keys), np.int64)
        high = np.full(len(keys), len(self.order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            place = self.order[np.minimum(middle, len(self.order) - 1)]
            less, decided = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            for k in range(keys.shape[1]):
                theirs = self.keys[place + 3 * k] & masks[:, k]
                less |= ~decided & (theirs < keys[:, k])
                decided |= theirs != keys[:, k]
            right = open_ & (less | (~decided if upper else False))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low


class Benchmark(NamedTuple):
    """A block of benchmark texts: their words and the suffixes to look up."""

    ids: list[str]
    hashes: np.ndarray
    ends: np.ndarray  # of the text that each word is in
    item: np.ndarray  # of each word
    starts: np.ndarray  # first words of the suffixes that hold a window
    lengths: np.ndarray  # of their windows

    @staticmethod
    def of(ids: list[str], texts: list[str], window: int) -> Benchmark:
        words = scan(pa.array(texts, pa.string()), ALNUM, lower=True)
        item = words.text_of()
        ends = words.first[1:][item]
        left = ends - np.arange(len(item))
        whole = words.counts()[item]
        starts = np.flatnonzero((left >= window) | (left == whole))
        return Benchmark(ids, words.hashes(), ends, item, starts, np.minimum(whole, window)[starts])

    def queries(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows as packed words, and what counts of them."""
        threes = -(-window // 3)
        wide = np.concatenate([codes_of(self.hashes), np.zeros(window + 3, np.uint64)])
        place = np.arange(3 * threes)
        block = np.where(place < self.lengths[:, None], wide[self.starts[:, None] + place], np.uint64(0))
        mask = np.where(place < self.lengths[:, None], _LOW, np.uint64(0))
        shifts = np.array([2 * _BITS, _BITS, 0], np.uint64)
        put = lambda x: (x.reshape(len(x), threes, 3) << shifts).sum(axis=2, dtype=np.uint64)
        return put(block), put(mask)


def found_windows(hashes: np.ndarray, ends: np.ndarray, bench: Benchmark, window: int) -> tuple[np.ndarray, ...]:
    """Places, suffix starts in the benchmark, window lengths and longest matches
    of the windows found in a shard's words; ``ends`` of the text of each word."""
    if not len(bench.starts):
        return (np.zeros(0, np.int64),) * 4
    codes = codes_of(hashes)
    # the end of a text comes between: words of two texts are never one window
    text_start = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    gap = np.zeros(len(hashes), np.int64)
    gap[text_start] = 1
    place_of = np.arange(len(hashes)) + np.cumsum(gap)
    wide = np.zeros(len(hashes) + len(text_start) + 1, np.uint64)
    wide[place_of] = codes
    back = np.full(len(wide), -1)
    back[place_of] = np.arange(len(hashes))
    array = SuffixArray(wide, window)
    low, high = array.search(*bench.queries(window))
    found = [[np.zeros(0, np.int64)] * 4]
    run = np.maximum(high - low, 0)
    hit = np.flatnonzero(run)
    # as many pairs at a time as there are words, so that arrays stay in bounds
    share = np.cumsum(run[hit]) // max(len(hashes), 1 << 16)
    for own in np.split(hit, np.flatnonzero(np.diff(share)) + 1):
        count = run[own]
        first = np.cumsum(count) - count
        place = back[array.order[np.arange(count.sum()) - np.repeat(first - low[own], count)]]
        start, length = np.repeat(bench.starts[own], count), np.repeat(bench.lengths[own], count)
        longest = _agreement(hashes, place, ends[place], bench, start)
        whole = longest >= length
        found.append([x[whole] for x in (place, start, length, longest)])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _agreement(hashes: np.ndarray, place: np.ndarray, ends: np.ndarray, bench: Benchmark, start: np.ndarray) -> np.ndarray:
    """How many words agree from each place and each suffix start on."""
    room = np.minimum(ends - place, bench.ends[start] - start)
    longest = np.zeros(len(place), np.int64)
    open_ = np.flatnonzero(room > 0)
    step = 0
    while len(open_):
        same = hashes[place[open_] + step] == bench.hashes[start[open_] + step]
        step += 1
        open_ = open_[same]
        longest[open_] = step
        open_ = open_[room[open_] > step]
    return longest


def matches(hashes: np.ndarray, ends: np.ndarray, bench: Benchmark, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``found_windows`` one by one."""
    yield from zip(*(x.tolist() for x in found_windows(hashes, ends, bench, window)), strict=True)


_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("item_word", T.LongType()),
            T.StructField("longest", T.LongType()),
        ]
    )
)


def _finder(text: str, block, window: int, schema: pa.Schema):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark.of(*block.value, window)
        # equal ids are neighbours, so they have one number
        number = np.cumsum([0, *(a != b for a, b in zip(bench.ids, bench.ids[1:], strict=False))]) if bench.ids else np.zeros(0, np.int64)
        item_first = np.searchsorted(bench.item, np.arange(len(bench.ids)))
        for piece in chunks(batches, text, SHARD_BYTES):
            words = scan(piece.column(text), ALNUM, lower=True)
            text_of = words.text_of()
            ends = words.first[1:][text_of]
            hit = np.zeros(len(text_of) + 1, np.int64)
            place, start, length, longest = found_windows(words.hashes(), ends, bench, window)
            np.add.at(hit, place, 1)
            np.subtract.at(hit, place + length, 1)
            row, item = text_of[place], bench.item[start]
            at, item_word = place - words.first[row], start - item_first[item]
            order = np.lexsort((item_word, at, -longest, number[item], row))
            row, item, at, item_word, longest = (x[order] for x in (row, item, at, item_word, longest))
            best = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[item[1:]] != number[item[:-1]])]) if len(row) else row
            found: dict[int, list[dict]] = {}
            for k in best.tolist():
                one = {"item_id": bench.ids[item[k]], "first_word": int(at[k]), "item_word": int(item_word[k]), "longest": int(longest[k])}
                found.setdefault(int(row[k]), []).append(one)
            covered = np.cumsum(hit[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            spans = [None] * piece.num_rows
            lists = [None] * piece.num_rows
            for k, items in found.items():
                spans[k] = np.flatnonzero(covered[words.first[k] : words.first[k + 1]]).tolist()
                lists[k] = items
            values = {
                "n_words": pa.array(words.counts(), pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "hit_words": pa.array(spans, pa.list_(pa.int64())),
                "matches": pa.array(lists, to_arrow_schema(T.StructType([T.StructField("m", _FOUND)])).field("m").type),
            }
            columns = [values[f.name] if f.name in values else piece.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return find


_ADDED = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_words", T.ArrayType(T.LongType())), ("matches", _FOUND)]


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``hit_words`` (places of the hit
    words) and ``matches``: for each item found its longest verbatim match.

    Both lists are null where nothing is hit. They replace columns of the same
    names.
    """
    df = df.drop(*[n for n, _ in _ADDED])
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.coalesce(item_text, F.lit("")).alias("text"))
    items = items.distinct()
    fine = F.pmod(F.xxhash64("id", "text"), F.lit(FINE)).alias("part")
    parts = items.groupBy(fine).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    groups = _blocks(sorted((r["part"], r["bytes"]) for r in parts), block_bytes)
    result = T.StructType([*df.schema.fields, *[T.StructField(c, t) for c, t in _ADDED]])
    if len(groups) == 1:
        return df.mapInArrow(_finder(text, _sent(items), window, to_arrow_schema(result)), result)
    return _merged(df, text, [items.where(fine.between(*g)) for g in groups], window)


def _blocks(parts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """First and last parts of blocks that have at most ``most`` bytes or one part."""
    blocks: list[list[int]] = []
    for part, size in parts:
        if blocks and blocks[-1][2] + size <= most:
            blocks[-1][1:] = part, blocks[-1][2] + size
        else:
            blocks.append([part, part, size])
    return [(a, b) for a, b, _ in blocks] or [(0, FINE)]


def _sent(items: DataFrame) -> Broadcast:
    """A block of items in order, for all tasks."""
    rows = sorted(items.collect(), key=lambda r: (r["id"] is None, r["id"] or "", r["text"]))
    return items.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], [r["text"] for r in rows]))


def _merged(df: DataFrame, text: str, blocks: list[DataFrame], window: int) -> DataFrame:
    """The findings of several blocks, one after the other. Equal texts have
    equal findings, so they are gathered by the text's digest, only for texts
    that are hit."""
    digest, hits = free_name(df, "__text"), None
    texts = df.select(F.sha2(F.col(text), 256).alias("digest"), F.col(text).alias("text"))
    result = T.StructType([*texts.schema.fields, *[T.StructField(c, t) for c, t in _ADDED]])
    for block in blocks:
        sent = _sent(block)
        found = texts.mapInArrow(_finder("text", sent, window, to_arrow_schema(result)), result)
        found = found.where("matches is not null").groupBy("digest").agg(
            F.first("hit_words").alias("hit_words"), F.first("matches").alias("matches")
        )
        found = materialise(found, "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionAll(found)
    spans = hits.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"))
    one = hits.select("digest", F.explode("matches").alias("m"))
    best = one.groupBy("digest", F.col("m.item_id").alias("item_id")).agg(
        F.min(F.struct((-F.col("m.longest")).alias("less"), F.col("m.first_word").alias("first_word"), F.col("m.item_word").alias("item_word"))).alias("b")
    )
    match = F.struct("item_id", "b.first_word", "b.item_word", (-F.col("b.less")).alias("longest"))
    # null ids come last, as in one block
    ordered = F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), match.alias("m"))))
    lists = best.groupBy("digest").agg(F.transform(ordered, lambda x: x["m"]).alias("matches"))
    hits = materialise(spans.join(lists, "digest"), "hits").withColumnRenamed("digest", digest)
    none = _finder(text, df.sparkSession.sparkContext.broadcast(([], [])), window, to_arrow_schema(_counted(df)))
    base = df.mapInArrow(none, _counted(df)).withColumn(digest, F.sha2(F.col(text), 256))
    out = base.join(hits, digest, "left").withColumn("n_hit", F.coalesce(F.size("hit_words"), F.lit(0)).cast("long"))
    return out.select(*df.columns, *[n for n, _ in _ADDED])


def _counted(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType())])
