"""Bloom filters over 64-bit hashes, built by tasks in shards.

A filter has ``BITS`` bits a hash up to ``MOST_BITS`` in all, so what is broadcast
has a bound; beyond it more rows pass. It never refuses a hash that went in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.llm.words import mix

BITS = 12
MOST_BITS = 2**28
SHARD_BITS = 2**20
PROBES = 4

_SEEDS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(PROBES)]


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of each hash within its shard."""
    return [mix(hashes + seed) % np.uint64(SHARD_BITS) for seed in _SEEDS]


def _fill(shard: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(SHARD_BITS, bool)
    for place in _places(table.column("h").to_numpy().view(np.uint64)):
        bits[place] = True
    return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()]})


def may_hold(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test for a column of hashes (bigint): true if it may be among those in
    the first column of ``hashes``, false only if it is not. Nulls are never in."""
    hashes = hashes.select(F.col(hashes.columns[0]).alias("h")).where("h is not null")
    count = hashes.count()
    shards = max(1, -(-min(MOST_BITS, BITS * count) // SHARD_BITS))
    # distinct first: one hash may stand in very many rows
    dealt = hashes.distinct().withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    rows = dealt.groupBy("shard").applyInArrow(_fill, "shard int, bits binary").collect()
    blobs: list = [None] * shards
    for row in rows:
        blobs[row["shard"]] = bytes(row["bits"])
    sent = hashes.sparkSession.sparkContext.broadcast(blobs)

    @F.pandas_udf("boolean")
    def test(h: pd.Series, shard: pd.Series) -> pd.Series:
        found = np.zeros(len(h), bool)
        known = h.notna().to_numpy()
        places = _places(h.fillna(0).to_numpy(np.int64).view(np.uint64))
        of = shard.to_numpy(np.int64)
        for k in np.unique(of):
            blob = sent.value[k]
            if blob is not None:
                bits = np.frombuffer(blob, np.uint8)
                own = np.flatnonzero(of == k)
                inside = known[own]
                for place in places:
                    at = place[own]
                    inside = inside & ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
                found[own] = inside
        return pd.Series(found)

    return lambda h: test(h, F.pmod(F.xxhash64(h), F.lit(shards)).cast("int"))
