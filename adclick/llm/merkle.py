"""Document fingerprints: Merkle trees over sections, paragraphs and word runs.

A paragraph is a line. Its leaves are runs of words, short ones first, so a
paragraph's leaves up to an edit stay as they are. A section ends after a blank
paragraph or one whose digest ends in three zero bits, so sections beside an
edit stay as they are too. Every level hashes the digests of the one below;
the root (128 bits) tests equality. The printed fingerprint is the root and the
tree's leaves in short form: sections apart by ``|``, paragraphs by ``,``, and
twelve characters (72 bits) for each leaf; differing branches are found by comparing it.

``neighbours`` gives every row the one that follows it by descending id, of
equal ids by descending hash of the text. This order is cut into ranges at
approximate quantiles: of the ids, of the hashes where an id (or null) fills
several ranges, and of row numbers where a text does. The first row of each
range is also sent to the range before. So each range, a bounded part of the table,
knows all it needs, and the text is shuffled once. Only the range bounds and
first ids, one for each range, reach the driver. Row numbers are the same again
if the input is read in a fixed order, as files and written tables are.

Null text is the empty text, which has one empty leaf. Null ids come last.
Rows with the same id go by a hash of their text; the order of equal rows does
not matter. A table of one row follows itself; an empty one gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of the leaves of a paragraph, in turn; the last size repeats.
LEAF_WORDS = (2, 2, 4, 4, 4, 8, 8, 8, 8, 8, 16)
# Ranges for each shuffle partition, to even out what hashing deals together.
RANGES = 4
# Characters of a printed leaf; four hold three bytes.
WIDTH = 12


def _bounds(words: int) -> list[int]:
    out, size = [0], 0
    while out[-1] < words:
        out.append(out[-1] + LEAF_WORDS[min(size, len(LEAF_WORDS) - 1)])
        size += 1
    return out if len(out) > 1 else [0, 1]


_BOUNDS = [_bounds(n) for n in range(400)]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _paragraph(text: str) -> tuple[str, bytes]:
    """A paragraph's leaves in short form and its digest."""
    words = text.split(" ")
    bounds = _BOUNDS[len(words)] if len(words) < len(_BOUNDS) else _bounds(len(words))
    leaves = [_digest(" ".join(words[a:b]).encode()) for a, b in zip(bounds, bounds[1:], strict=False)]
    short = base64.b64encode(b"".join([x[:9] for x in leaves])).decode()
    return short, _digest(b"p" + b"".join(leaves))


def fingerprint(text: str | None, seen: dict[str, tuple[str, bytes]] | None = None) -> str:
    """The fingerprint of a text; ``seen`` keeps paragraphs for a like text."""
    seen = {} if seen is None else seen
    sections, shorts, digests, own = [], [], [], []
    for line in (text or "").split("\n"):
        found = seen.get(line)
        if found is None:
            found = seen[line] = _paragraph(line)
        shorts.append(found[0])
        digests.append(found[1])
        if not line.strip() or not found[1][-1] & 7:
            sections.append(",".join(shorts))
            own.append(_digest(b"s" + b"".join(digests)))
            shorts, digests = [], []
    if shorts:
        sections.append(",".join(shorts))
        own.append(_digest(b"s" + b"".join(digests)))
    return _digest(b"r" + b"".join(own)).hex() + ":" + "|".join(sections)


def leaves(printed: str) -> Counter:
    runs = printed.partition(":")[2].replace("|", ",").split(",")
    return Counter([run[i : i + WIDTH] for run in runs for i in range(0, len(run), WIDTH)])


def likeness(a: str, b: str) -> float:
    """1 for equal roots; else the share of leaves that both have (Jaccard)."""
    if a[:32] == b[:32]:
        return 1.0
    return _overlap(leaves(a), leaves(b))


def _overlap(a: Counter, b: Counter) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = sum([min(n, large[x]) for x, n in small.items() if x in large])
    return both / (a.total() + b.total() - both)


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) places of ``b`` that ``a`` lacks, top down:
    equal roots have none, and what both begin or end with, sections that both
    have and then paragraphs that both have are not opened. Time is linear in the
    leaves. What was taken out is found the other way round; where things only
    changed places, all between the common ends differ."""
    if a[:32] == b[:32]:
        return []
    old, new = (x.partition(":")[2].split("|") for x in (a, b))
    low, high = _common_ends(old, new)
    middle = [(s, new[s]) for s in range(low, len(new) - high)]
    before, after = _lacking(old[low : len(old) - high], middle)
    paragraphs = [((s, k), p) for s, section in after for k, p in enumerate(section.split(","))]
    before, after = _lacking([p for section in before for p in section.split(",")], paragraphs)
    cut = lambda run: [run[i : i + WIDTH] for i in range(0, len(run), WIDTH)]
    places = [((*place, i), leaf) for place, run in after for i, leaf in enumerate(cut(run))]
    before, after = _lacking([leaf for run in before for leaf in cut(run)], places)
    if not before and not after:  # the same leaves in another order
        return [(s, k, i) for s, section in middle for k, p in enumerate(section.split(",")) for i in range(len(cut(p)))]
    return [place for place, _ in after]


def _common_ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many items both begin with, and how many of the rest they end with."""
    most = min(len(a), len(b))
    low = next((i for i in range(most) if a[i] != b[i]), most)
    high = next((i for i in range(most - low) if a[-1 - i] != b[-1 - i]), most - low)
    return low, high


def _lacking(old: list[str], new: list[tuple]) -> tuple[list[str], list[tuple]]:
    """What of ``old`` is not in ``new``, and of ``new`` (place, item) not in
    ``old``; each item answers for one like it."""
    left, after = Counter(old), []
    for place, item in new:
        if left[item] > 0:
            left[item] -= 1
        else:
            after.append((place, item))
    return list(left.elements()), after


_BRANCH = T.StructType([T.StructField(n, T.IntegerType()) for n in ("section", "paragraph", "leaf")])


@F.pandas_udf(T.ArrayType(_BRANCH))
def edited_branches(a: pd.Series, b: pd.Series) -> pd.Series:
    """Where two columns of fingerprints differ; null where one is null."""
    return pd.Series([None if x is None or y is None else differing(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def fingerprints(text: pd.Series) -> pd.Series:
    """The fingerprints of a column of texts."""
    return pd.Series([fingerprint(t) for t in text], dtype=object)


# A place in the order: an id, 52 bits of hash of the text, a hash of a row number.
_Place = tuple[int, int, int]
_LOWEST = -(2**63)


def _cuts(values: list[int], prefix: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """Distinct quantiles as bounds after ``prefix``, and how many ranges each fills."""
    return [((*prefix, v), n) for v, n in sorted(Counter(values).items())]


def _quantiles(column: str, parts: int) -> Column:
    shares = [(i + 1) / parts for i in range(parts - 1)] or [1.0]
    return F.percentile_approx(column, F.lit(shares), F.lit(10 * parts))


def _bounds_of(docs: DataFrame, parts: int) -> tuple[list[_Place], list[_Place]]:
    """Lower bounds of ranges among rows with an id and among those without.
    An id that fills several ranges is cut by hash; a hash that does, evenly by
    the hash of the row number."""
    row = docs.agg(_quantiles("key", parts).alias("cuts"), F.count("*").alias("n"), F.count("key").alias("keyed")).first()
    keys = _cuts(row["cuts"] or [], ())
    hot = {k[0]: n + 1 for k, n in keys if n > 1}
    nulls = -(-parts * (row["n"] - row["keyed"]) // max(row["n"], 1))
    of = docs.where(F.col("key").isin(list(hot)) | F.col("key").isNull() & F.lit(nulls > 1))
    within = {r["key"]: r["cuts"] for r in of.groupBy("key").agg(_quantiles("order", parts).alias("cuts")).collect()}

    def inside(key: int | None, prefix: int, ranges: int) -> list[_Place]:
        found: list[_Place] = []
        # ``parts`` quantiles, of which the ranges of this id need a share
        for (_, order), n in _cuts(within[key][:: max(1, parts // ranges)], (prefix,)):
            found.append((prefix, order, _LOWEST))
            found += [(prefix, order, _LOWEST + 2**64 * i // n) for i in range(1, n)]
        return found

    keyed = [(k[0], _LOWEST, _LOWEST) for k, _ in keys]
    for key, ranges in hot.items():
        keyed += inside(key, key, ranges)
    return sorted(set(keyed)), sorted(set(inside(None, 0, nulls))) if nulls > 1 else []


def _range_of(keyed: list[_Place], null: list[_Place]) -> Callable[..., Column]:
    bounds = np.array([b[0] for b in keyed], np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(key: pd.Series, order: pd.Series, tie: pd.Series) -> pd.Series:
        """Ranges count from the end of the order down; null ids have the last."""
        none = key.isna().to_numpy()
        own = key.fillna(0).to_numpy(np.int64)
        after = np.searchsorted(bounds, own, "right")
        out = len(keyed) - after
        several = after - np.searchsorted(bounds, own) > 1
        for k in np.flatnonzero(several & ~none).tolist():
            out[k] = len(keyed) - bisect_right(keyed, (int(own[k]), int(order[k]), int(tie[k])))
        for k in np.flatnonzero(none).tolist():
            out[k] = len(keyed) + 1 + len(null) - bisect_right(null, (0, int(order[k]), int(tie[k])))
        return pd.Series(out).astype("int32")

    return number


def neighbours(df: DataFrame, key: str, text: str, work: Callable[[Iterator[tuple]], pa.Table], schema: T.StructType) -> DataFrame:
    """Apply ``work`` to each range's (id, text, next text) in descending order."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # 52 bits, as quantiles are taken in floating point
    docs = docs.withColumn("order", F.shiftright(F.xxhash64("text"), 12))
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_of = _range_of(*_bounds_of(docs, parts))
    docs = docs.withColumn("range", range_of("key", "order", F.xxhash64(F.monotonically_increasing_id())))

    # one row for each range; rows of one place in the order have one text
    firsts = docs.groupBy("range").agg(F.max(F.struct("key", "order")).alias("m")).select("range", "m.key", "m.order").collect()
    firsts.sort(key=lambda r: r["range"])
    peeks = [(firsts[i - 1]["range"], r["key"], r["order"]) for i, r in enumerate(firsts)]
    peeks = spark.createDataFrame(peeks, "range int, peek_key bigint, peek_order bigint")
    same = F.col("key").eqNullSafe(F.col("peek_key")) & (F.col("order") == F.col("peek_order"))
    places = peeks.select("peek_key", "peek_order").distinct()
    sent = docs.drop("range").join(F.broadcast(places), same, "left_semi").dropDuplicates(["key", "order"])
    sent = sent.join(F.broadcast(peeks), same)
    both = docs.withColumn("peek", F.lit(False)).unionByName(
        sent.select("key", "text", "order", "range", F.lit(True).alias("peek"))
    )

    def by_range(table: pa.Table) -> pa.Table:
        table = table.sort_by([("peek", "ascending"), ("key", "descending"), ("order", "descending")])
        return work(_successions(table))

    return both.groupBy("range").applyInArrow(by_range, schema)


def _successions(table: pa.Table) -> Iterator[tuple]:
    """(id, text, next text); the last row is the peek. Nulls sort last."""
    held = None
    for batch in table.to_batches(max_chunksize=64):
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if held is not None:
                yield *held, text
            held = key, text


def _edits(rows: Iterator[tuple]) -> pa.Table:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_differing")
    values: dict[str, list] = {n: [] for n in names}
    ready = None
    for key, text, after in rows:
        seen: dict[str, tuple[str, bytes]] = {}
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = fingerprint(text, seen) if ready is None else ready
        changed = fingerprint(edited, seen)
        ready = fingerprint(after)
        mine = leaves(own)
        near = [1.0 if own[:32] == x[:32] else _overlap(mine, leaves(x)) for x in (changed, ready)]
        row = (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near, len(differing(own, changed)))
        for name, value in zip(names, row, strict=True):
            values[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    return pa.table({n: pa.array(v, k) for (n, v), k in zip(values.items(), kinds, strict=True)})


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of a copy whose last third is replaced by the
    beginning of the next text, their likenesses, and how many leaves of the copy
    differ."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            *[T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")],
            T.StructField("n_differing", T.LongType()),
        ]
    )
    return neighbours(df, key, text, _edits, schema)
