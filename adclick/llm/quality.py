"""Text quality by compression with two trained dictionaries.

One zstandard dictionary is built from texts labelled good, one from texts
labelled bad. A text is compressed in pieces with either; what counts is the
difference of its two compressed sizes in relation to its length, and how far
it can be compressed at all. Logistic regression on these sizes, fitted on
labelled texts that the dictionaries have not seen, makes a probability of them.

Labels are learned from a bounded sample: ``SLOTS`` documents a class, of each
at most ``PIECES`` pieces of ``PIECE_CHARS`` characters at places given by a
hash. Scoring is a narrow pass over whole texts, without a shuffle.

Null and empty texts compress to nothing and get the score of such sizes.
Documents labelled both ways are not learned from, nor null ids. Where a class
has no labelled text at all, every score is the share of label 1, or 0.5. Other
columns pass through; ``score`` replaces an older one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.labelled import labelled_ids
from adclick.llm.logistic import fit_logistic
from adclick.llm.words import chunks, text_buffers

SLOTS = 1200
PIECES = 4
PIECE_CHARS = 2000
PIECE_BYTES = 4096  # compressed at a time when scoring
DICTIONARY_BYTES = 128 * 1024
LEVEL = 3


class Model(NamedTuple):
    dictionaries: tuple[bytes, bytes] | None  # bad, good
    weights: np.ndarray


class Sizes:
    """Compressed sizes under both dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.compressors = []
        for content in dictionaries:
            own = zstandard.ZstdCompressionDict(content)
            plain = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False
            )
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=plain))

    def of(self, text: memoryview) -> tuple[int, int]:
        bad = good = 0
        for at in range(0, len(text), PIECE_BYTES):
            piece = text[at : at + PIECE_BYTES]
            bad += len(self.compressors[0].compress(piece))
            good += len(self.compressors[1].compress(piece))
        return bad, good


def features(length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The normalised difference, the compressibility and what bends them."""
    n = np.maximum(length, 1)
    difference = (sizes[:, 0] - sizes[:, 1]) / n
    rate = sizes.min(axis=1) / n
    short = 1 / np.sqrt(n + 10)
    return np.stack([difference, np.abs(difference), rate, rate * rate, np.log(rate + 0.02), short], axis=1)


def fit(df: DataFrame, labels: DataFrame, key: str, learn: Column, text: str = "text", label: str = "quality") -> Model:
    """Learn from the labelled rows for which ``learn``, over the key, holds."""
    chosen = labelled_ids(labels, key, label, learn, SLOTS)
    room = F.greatest(F.lit(1), F.length(text) - PIECE_CHARS + 1)
    cuts = [
        F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(k)), room) + 1).cast("int"), F.lit(PIECE_CHARS))
        for k in range(PIECES)
    ]
    whole = F.length(text) <= PIECE_CHARS
    taken = df.select(F.col(key).alias("id"), F.when(whole, F.array(text)).otherwise(F.array(*cuts)).alias("cuts"))
    rows = taken.where("cuts is not null").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("cuts").alias("cuts")).collect()
    rows = sorted((r["id"], r["label"], [c.encode() for c in r["cuts"] if c]) for r in rows)
    known = labels.where(learn & F.col(key).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return learn_from([(y, cuts) for _, y, cuts in rows if cuts], known)


def learn_from(rows: list[tuple[int, list[bytes]]], share: float | None = None) -> Model:
    """A model of labelled pieces; ``share`` of label 1 among all labelled rows
    sets the intercept, as the sample takes as many of either label."""
    drawn = float(np.mean([y for y, _ in rows])) if rows else 0.5
    share = drawn if share is None else share
    base = Model(None, np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)) if rows else 0.0]))
    apart = [i for i in range(len(rows)) if i % 5 < 3]
    dictionaries = tuple(_dictionary([c for i in apart if rows[i][0] == y for c in rows[i][1]]) for y in (0, 1))
    rest = [rows[i] for i in range(len(rows)) if i % 5 >= 3]
    if not all(dictionaries) or len({y for y, _ in rest}) < 2:
        return base
    sizes = Sizes(dictionaries)
    length = np.array([sum(map(len, cuts)) for _, cuts in rest])
    found = np.array([np.sum([sizes.of(c) for c in cuts], axis=0) for _, cuts in rest])
    y = np.array([y for y, _ in rest])
    weights = fit_logistic(features(length, found), y)
    odds = lambda x: np.log(max(x, 1e-3) / max(1 - x, 1e-3))
    weights[0] += odds(share) - odds(y.mean())
    return Model(dictionaries, weights)


def _dictionary(samples: list[bytes]) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _scorer(text: str, model, schema: pa.Schema):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        sizes = Sizes(own.dictionaries) if own.dictionaries else None
        for piece in chunks(batches, text):
            data, offsets = text_buffers(piece.column(text))
            if sizes is None:
                logit = np.full(piece.num_rows, own.weights[0])
            else:
                view = memoryview(data)
                bounds = offsets.tolist()
                found = np.array([sizes.of(view[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]).reshape(-1, 2)
                logit = own.weights[0] + features(np.diff(offsets), found) @ own.weights[1:]
            p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            columns = [pa.array(p) if f.name == "score" else piece.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return score


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score``, the probability of label 1."""
    df = df.drop("score")
    result = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_scorer(text, shared, to_arrow_schema(result)), result)
