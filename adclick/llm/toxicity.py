"""Toxicity of texts whose disguised words are restored first.

1. Character trigrams are counted over all texts: tasks add up their own, a
   shuffle adds up theirs. The model has a fixed size (28 symbols).
2. ``deobfuscate`` restores disguised stretches under that model.
3. Words of the restored texts, and their beginnings, are weighed by the
   log-odds of the labels of the texts that hold them; a text is scored by
   its heaviest words, their number and their share, through logistic regression.

Labels are learned from a bounded sample, ``SLOTS`` documents a class: a part
of it weighs the words, the rest fits the
regression. Scoring is a narrow pass over whole texts.

Null and empty texts have no words and get the score of such. Documents
labelled both ways and null ids are not learned from. Where a class has no
labelled text, every score is the share of label 1, or 0.5 without labels.
Other columns pass through; ``score`` and ``restored`` replace older ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.deobfuscate import SYMBOLS, Restorer, trigram_counts, trigram_model
from adclick.llm.labelled import labelled_ids
from adclick.llm.logistic import fit_logistic
from adclick.llm.words import Words, chunks, mix, scan, text_buffers
from adclick.sources.scratch import materialise

SLOTS = 3000
BEGINNINGS = (4, 5, 6)  # bytes
LEAST = 5  # texts of label 1 that a feature must be in
STRONG = 2.0  # log-odds from which a word counts as heavy

#: ASCII letters and all bytes above ASCII.
LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


class Model(NamedTuple):
    counts: np.ndarray  # of character trigrams
    features: np.ndarray  # ascending hashes
    odds: np.ndarray
    weights: np.ndarray


def count_trigrams(df: DataFrame, text: str = "text") -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for piece in chunks(batches, text):
            total += trigram_counts(text_buffers(piece.column(text))[0])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["gram", "n"])

    rows = df.select(text).mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(SYMBOLS**3, np.int64)  # at most this many rows come back
    for gram, n in rows:
        total[gram] = n
    return total


def word_features(words: Words) -> np.ndarray:
    """Hashes of the whole word and its beginnings, a row for each word; 0 where
    it is too short."""
    out = np.zeros((len(words.starts), 1 + len(BEGINNINGS)), np.uint64)
    size = words.ends - words.starts
    long = size >= BEGINNINGS[0]
    out[long, 0] = words._replace(starts=words.starts[long], ends=words.ends[long]).hashes()
    for k, n in enumerate(BEGINNINGS):
        long = size > n
        out[long, k + 1] = mix(words._replace(starts=words.starts[long], ends=words.starts[long] + n).hashes() + np.uint64(1))
    return out


def summaries(words: Words, features: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """For each text: its heaviest log-odds, the logarithm of how many words are
    heavy, and their share."""
    found = word_features(words)
    at = np.minimum(np.searchsorted(features, found.ravel()), max(len(features) - 1, 0))
    value = np.where(features[at] == found.ravel(), odds[at], 0.0).reshape(found.shape) if len(features) else np.zeros(found.shape)
    heavy = value.max(axis=1, initial=0.0)
    counts = words.counts()
    filled = counts > 0
    most, many = np.zeros(len(counts)), np.zeros(len(counts))
    if len(heavy):
        first = words.first[:-1][filled]
        most[filled] = np.maximum.reduceat(heavy, first)
        many[filled] = np.add.reduceat((heavy > STRONG).astype(float), first)
    share = many / np.maximum(counts, 1)
    return np.stack([most, np.log1p(many), np.sqrt(share)], axis=1)


def _counted(shared):
    """(feature, label, texts) of the restored texts of each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(trigram_model(shared.value))
        for piece in chunks(batches, "text"):
            words = scan(restorer.restore(piece.column("text")), LETTERS, lower=True)
            found = word_features(words)
            row = np.repeat(words.text_of(), found.shape[1])
            order = np.lexsort((found.ravel(), row))
            value, row = found.ravel()[order], row[order]
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])[: len(value)] & (value != 0)
            label = piece.column("label").to_numpy(zero_copy_only=False)[row[new]]
            for y in (0, 1):
                feature, n = np.unique(value[new][label == y], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature.view(np.int64)), pa.array(np.full(len(n), y), pa.int32()), pa.array(n)], names=["feature", "label", "n"]
                )

    return count


def _summarised(shared):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, features, odds = shared.value
        restorer = Restorer(trigram_model(counts))
        for piece in chunks(batches, "text"):
            words = scan(restorer.restore(piece.column("text")), LETTERS, lower=True)
            found = summaries(words, features, odds)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("label"), *(pa.array(found[:, k]) for k in range(3))], names=["id", "label", "a", "b", "c"]
            )

    return summarise


def fit(df: DataFrame, labels: DataFrame, key: str, learn: Column, text: str = "text", label: str = "toxic") -> Model:
    """Learn from all texts, and from labels of rows for which ``learn`` holds."""
    context = df.sparkSession.sparkContext
    counts = count_trigrams(df, text)
    chosen = labelled_ids(labels, key, label, learn, SLOTS)
    sample = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    sample = sample.join(F.broadcast(chosen.select(F.col("id").cast("bigint").alias("id"), "label")), "id").dropDuplicates(["text", "label"])
    sample = materialise(sample, "labelled")
    weighs = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) < 3
    sizes = {r["label"]: r["n"] for r in sample.where(weighs).groupBy("label").agg(F.count("*").alias("n")).collect()}
    known = labels.where(learn & F.col(key).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    none = Model(counts, np.zeros(0, np.uint64), np.zeros(0), np.array([_odds(0.5 if known is None else known), 0.0, 0.0, 0.0]))
    if len(sizes) < 2:
        return none

    found = sample.where(weighs).mapInArrow(_counted(context.broadcast(counts)), "feature bigint, label int, n bigint")
    each = [F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    odds = F.log((F.col("n1") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n0") + 0.5) / (sizes[0] + 1))
    found = found.groupBy("feature").agg(*each).where(F.col("n1") >= LEAST).withColumn("odds", odds).where("odds > 0")
    rows = found.select("feature", "odds").collect()  # no more than the sample's texts hold
    features = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    weight = np.array([r[1] for r in rows])
    order = np.argsort(features)
    features, weight = features[order], weight[order]

    shared = context.broadcast((counts, features, weight))
    rest = sample.where(~weighs).mapInArrow(_summarised(shared), "id bigint, label int, a double, b double, c double")
    rest = sorted(rest.collect())  # the sample is bounded
    y = np.array([r["label"] for r in rest])
    if len(set(y.tolist())) < 2:
        return none
    weights = fit_logistic(np.array([r[2:] for r in rest]), y, penalty=1e-5)
    weights[0] += _odds(known) - _odds(y.mean())
    return Model(counts, features, weight, weights)


def _odds(share: float) -> float:
    return float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))


def _scorer(text: str, shared, give: bool, schema: pa.Schema):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        restorer = Restorer(trigram_model(model.counts))
        for piece in chunks(batches, text):
            restored = restorer.restore(piece.column(text))
            words = scan(restored, LETTERS, lower=True)
            logit = model.weights[0] + summaries(words, model.features, model.odds) @ model.weights[1:]
            values = {"score": pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))} | ({"restored": restored} if give else {})
            columns = [(values[f.name] if f.name in values else piece.column(f.name)).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return score


def score(df: DataFrame, model: Model, text: str = "text", restored: bool = False) -> DataFrame:
    """``df`` with ``score``, and on request the ``restored`` texts."""
    df = df.drop("score", *["restored"] * restored)
    added = [T.StructField("score", T.DoubleType())] + [T.StructField("restored", T.StringType())] * restored
    result = T.StructType([*df.schema.fields, *added])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_scorer(text, shared, restored, to_arrow_schema(result)), result)
