"""Near duplicates: one-permutation MinHash, banded buckets, star edges, then
exact links.

1. One pass takes the set of hashed word shingles of each text, its digest and
   its one-permutation signature: the hash range is cut into as many bins as
   the signature is long, each bin keeps its least hash, and an empty bin takes
   that of the first occupied bin in a random order of its own (optimal
   densification).
2. Equal sets are one node, so groups of copies weigh nothing from here on.
3. Nodes that share a band meet in a bucket, which links each to its least
   node only: a bucket of n nodes gives n - 1 candidate edges.
4. The components of the candidate edges are what has to be compared. A small
   one is a group, so each of its texts moves once. In a large one, which chance
   meetings may have chained together, only sets that share a bucket are
   compared where that moves less: there every bucket is a group. A group that is too large for a task
   is cut into blocks by its number of shingles, and each pair of blocks goes
   to a task of its own. Within a task an inverted index gives the true
   intersections, and only links between parts not yet joined are returned. No
   link between two sets of a bucket is lost, whichever of them was the star's
   centre.
   The texts of candidates are read again: a Bloom filter of their hashes lets
   through few others, and the join that follows is exact.
5. The components of the true links are the classes.

There are as many bands of ``ROWS`` rows as it takes that two sets just at the
threshold share none with a probability below one in a million. Hashes of
shingles have 64 bits and stand for the shingles.

Null and empty texts, and such without words, are linked with nothing. Rows
with the same id and rows with equal texts are in one class. A null id is in
the class of its text, whose id is the least that is not null. Ties cannot
occur, as the threshold is compared in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.bloom import may_hold
from adclick.llm.graph import components
from adclick.llm.words import NOT_SPACE, chunks, mix, scan, window_hashes
from adclick.sources.scratch import discard, materialise

ROWS = 5
MISS = 1e-6
# Shingles of one block; a task compares at most two blocks.
BLOCK_SHINGLES = 1_000_000

def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles; the whole
    sequence is one shingle where there are fewer words."""
    words = scan(column, NOT_SPACE, lower=True)
    hashes = words.hashes()
    shingles = window_hashes(hashes, size)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= size:
            yield np.unique(shingles[low : high - size + 1])
        else:
            yield window_hashes(hashes[low:high], high - low) if high > low else hashes[:0]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class OnePermutation:
    """Signatures and bands of sets of 64-bit hashes."""

    def __init__(self, bands: int, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(8)
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], dtype=np.uint64)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.factors = rng.integers(1, 2**63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds = rng.integers(1, 2**63, size=bands, dtype=np.uint64)

    @staticmethod
    def for_threshold(percent: int) -> OnePermutation:
        return OnePermutation(max(1, int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** ROWS))))))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """One minimum for each bin of a set that is not empty."""
        at = np.searchsorted(shingles, self.edges)
        ends = np.append(at[1:], len(shingles))
        full = ends > at
        values = shingles[np.minimum(at, len(shingles) - 1)] - self.edges
        empty = np.flatnonzero(~full)
        if len(empty):
            donors = self.order[empty]
            first = full[donors].argmax(axis=1)
            values[empty] = values[donors[np.arange(len(empty)), first]]
        return values

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One hash for each band of each row of signatures."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows) * self.factors
        return mix(parts.sum(axis=2, dtype=np.uint64) + self.seeds)


def _marks(text: str, size: int, percent: int, schema: pa.Schema):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = OnePermutation.for_threshold(percent)
        none = np.zeros(layout.bins, np.uint64)
        for piece in chunks(batches, text):
            counts, ids, signatures = [], [], []
            for shingles in shingle_sets(piece.column(text), size):
                counts.append(len(shingles))
                ids.append(digest(shingles) if len(shingles) else None)
                signatures.append(layout.signature(shingles) if len(shingles) else none)
            keys = layout.keys(np.array(signatures, np.uint64).reshape(-1, layout.bins)).view(np.int64)
            offsets = pa.array(np.arange(len(counts) + 1) * layout.bands, pa.int32())
            values = {
                "n_shingles": pa.array(counts, pa.int64()),
                "set_id": pa.array(ids, pa.binary()),
                "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
            }
            columns = [(values[f.name] if f.name in values else piece.column(f.name)).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return marks


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among sets: 100 * intersection >= percent * union.

    A set joins to any other only if shingles that another one has too make up
    ``percent`` of it; those that fail are left out at once. The others are
    searched breadth first over an inverted index.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[token] > 1
    shared = np.bincount(owner[common], minlength=len(sets))
    able = 100 * shared >= percent * sizes
    keep = common & able[owner]
    owner, token = owner[keep], token[keep]
    own_first = np.searchsorted(owner, np.arange(len(sets) + 1))
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    post_first = np.searchsorted(token[order], np.arange(len(count) + 1))
    unseen, forest = able.copy(), []
    for root in np.flatnonzero(able):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue and unseen.any():
            here = queue.pop()
            mine = token[own_first[here] : own_first[here + 1]]
            hits = [posting[post_first[t] : post_first[t + 1]] for t in mine]
            both = np.bincount(np.concatenate(hits), minlength=len(sets)) if hits else np.zeros(len(sets), int)
            union = sizes + sizes[here] - both
            found = np.flatnonzero(unseen & (100 * both >= percent * union))
            unseen[found] = False
            forest.extend((int(root), int(x)) for x in found)
            queue.extend(found.tolist())
    return forest


def _links(text: str, size: int, percent: int, schema: pa.Schema):
    def links(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_pylist()
        sets = [s for piece in chunks(table.to_batches(), text) for s in shingle_sets(piece.column(text), size)]
        forest = linked(sets, percent) if len(sets) > 1 else []
        a, b = ([ids[e[side]] for e in forest] for side in (0, 1))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return links


def _text_hashes(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("hash_a"), F.hash(text).alias("hash_b")]


def near_duplicates(
    df: DataFrame, key: str, text: str = "text", size: int = 5, percent: int = 80, row: str | None = None
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``df``; if a column
    ``row`` is named, it and ``class_id``, the class whatever the ids of its
    rows, which is null for texts without words."""
    docs = df.select(F.col(text).alias("text"), *_text_hashes(F.col(text)))
    named = [] if row is None else [F.col(row).alias("row")]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *_text_hashes(F.col(text)), *named)
    added = [("n_shingles", T.LongType()), ("set_id", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]
    own = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*own, *[T.StructField(n, t) for n, t in added]])
    marks = materialise(rows.mapInArrow(_marks("text", size, percent, to_arrow_schema(schema)), schema), "marks")

    nodes = (
        marks.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min("key").alias("key"),
            F.count("*").alias("n"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.min(F.struct("hash_a", "hash_b")).alias("one"),
        )
        .withColumn("node", F.xxhash64("set_id"))
    )
    nodes = materialise(nodes, "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    # written down, as adaptive execution splits a hot key only of two plain tables
    heads = members.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = materialise(heads.select("band", "head"), "heads")
    stars = members.join(heads, "band").select(F.col("head").alias("a"), F.col("node").alias("b"))
    candidates = components(stars).withColumnRenamed("component", "group")

    in_parts = nodes.join(candidates, "node").select("group", "set_id", "one.*", "n_shingles", "bands")
    in_parts = materialise(in_parts, "parts")
    # what is sent, in shingles: of a part by its blocks, or by those of its buckets
    n = F.sum("n_shingles").alias("n")
    sent = F.col("n") * F.ceil(F.col("n") / BLOCK_SHINGLES)
    large = in_parts.groupBy("group").agg(n).where(F.col("n") > BLOCK_SHINGLES)
    large = materialise(large.select("group", sent.alias("by_part")), "large")
    bands = in_parts.join(large, "group").withColumn("band", F.explode("bands")).join(heads.select("band"), "band")
    by_band = bands.groupBy("group", "by_part", "band").agg(n).groupBy("group", "by_part").agg(F.sum(sent).alias("by_band"))
    chained = materialise(by_band.where("by_band < by_part").select("group"), "chained")
    columns = ["kind", "group", "set_id", "hash_a", "hash_b", "n_shingles"]
    small_parts = in_parts.join(chained, "group", "left_anti").withColumn("kind", F.lit("part"))
    bands = bands.join(chained, "group", "left_semi")
    bands = bands.select(F.lit("band").alias("kind"), F.col("band").alias("group"), *columns[2:])
    grouped = materialise(small_parts.select(*columns).unionByName(bands), "grouped")
    sizes = grouped.groupBy("kind", "group").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    sizes = materialise(sizes, "sizes")
    own = F.pmod(F.hash("set_id"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))
    )
    dealt = grouped.join(sizes, ["kind", "group"]).select("kind", "group", "set_id", "hash_a", "hash_b", F.explode(pairs).alias("pair"))
    # Each text is read once more. One text stands for a set, and one row for a
    # text: ids play no part, and tasks drop copies before the shuffle. Texts
    # that no group wants stay where they are, but for a few.
    wanted = may_hold(in_parts.select("hash_a"))
    once = docs.where(wanted(F.col("hash_a"))).dropDuplicates(["hash_a", "hash_b"])
    texts = dealt.join(once.hint("merge"), ["hash_a", "hash_b"]).select("kind", "group", "pair.i", "pair.j", "set_id", "text")
    edge = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    links = texts.groupBy("kind", "group", "i", "j").applyInArrow(_links("text", size, percent, to_arrow_schema(edge)), edge)
    links = materialise(links, "links")
    discard(heads, in_parts, large, chained, grouped, sizes)
    classes = components(links)

    named = nodes.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.select("set_id", "key", "n", "component", F.col("component").isNotNull().alias("linked"))
    named = materialise(named, "named")
    discard(links, nodes)
    least = named.where("linked").groupBy("component").agg(F.min("key").alias("component_id"))
    shared = named.join(least, "component", "left").where("linked or n > 1")
    shared = shared.select("set_id", F.coalesce("component_id", "key").alias("component_id"), "component")
    shared = materialise(shared, "classes")
    discard(named)
    out = marks.drop("bands").join(shared, "set_id", "left")
    component = F.coalesce("component_id", "key")
    kept = F.col("key").eqNullSafe(component).alias("kept")
    named = [] if row is None else [F.col("row").alias(row), F.coalesce("component", "set_id").alias("class_id")]
    return out.select(F.col("key").alias(key), *named, "n_shingles", component.alias("component_id"), kept)
