"""Language by a byte convolutional network, trained and applied in numpy.

Bytes fall into 64 classes (letters without case, digits, punctuation, lead and
continuation bytes). A text is cut into windows of ``LENGTH`` bytes, the last
one filled up with blanks; convolutions of several widths run over each window,
their maxima go through a rectifier and a softmax over the languages. A text's
prediction is the mean log-probability of its windows, weighted by their bytes.

Training takes a bounded sample: at most ``slots`` documents a language, of
each ``windows`` windows at places given by a hash. It runs on the driver on
these few megabytes. Applying is a narrow pass over whole texts, without a
shuffle; responses come from tables over pairs and triples of byte classes.

On request every fourth document of a language in the sample is kept out of the training and
sets a bound: the least score that the network gives to one of them, less a
margin. A text below it is less like any language than all that were labelled.

A null text and one without a letter are ``und`` with score 0. Without any
labelled row every text is ``und``. Ties go to the first language in order.
Null labels and null ids are not learned from. Other columns pass through; the
result columns replace older ones of the same names.
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

from adclick.llm.tables import free_name
from adclick.llm.words import chunks, text_buffers

LENGTH = 256
SLOTS = 512
WINDOWS = 4
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS = 300
BATCH = 64
UNKNOWN = "und"
# Share of the least held-out score that a text must reach.
MARGIN = 0.75

_CLASSES = 64
_APPLY = 1024  # windows at a time


def byte_classes() -> np.ndarray:
    """The class of each byte: 0 blank, 1-26 letters, 27 digits, 28 other ASCII,
    29-31 lead bytes by length, 32-63 continuation bytes, whose upper and lower
    case letters of Latin-1 agree."""
    out = np.full(256, 28, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[65:91] = out[97:123] = np.arange(1, 27)
    out[48:58] = 27
    out[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = 29, 30, 31
    return out


_CLASS_OF = byte_classes()


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of all windows (one at least for each text), the first
    window of each text with the total at the end, and the bytes of each window."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // LENGTH))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * LENGTH, np.uint8)
    shift = first[:-1] * LENGTH - offsets[:-1]
    out[np.arange(len(data)) + np.repeat(shift, sizes)] = _CLASS_OF[data]
    used = np.full(first[-1], LENGTH, np.int64)
    used[first[1:] - 1] = sizes - (count - 1) * LENGTH
    return out.reshape(-1, LENGTH), first, used


def _padded(windows: np.ndarray) -> np.ndarray:
    return np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))


def _pool(responses: np.ndarray) -> np.ndarray:
    """Maximum over the second axis, whose length is a power of two."""
    while responses.shape[1] > 1:
        half = responses.shape[1] // 2
        responses = np.maximum(responses[:, :half], responses[:, half:])
    return responses[:, 0]


class Network(NamedTuple):
    """``filters[w][k]`` holds what class c at offset k adds to each filter."""

    languages: list[str]
    filters: list[np.ndarray]  # (width, classes, filters)
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    offset: np.ndarray
    bound: float = 0.0

    def log_probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), _APPLY):
            pooled = [t.pooled(_padded(windows[at : at + _APPLY]).astype(np.int32)) for t in tables]
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            logits = hidden @ self.dense + self.offset
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + _APPLY] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def tables(self) -> list[_Table]:
        return [_Table(f) for f in self.filters]


class _Table:
    """Responses of one width as sums of tables over two byte classes each."""

    def __init__(self, filters: np.ndarray):
        self.scale = max(float(np.abs(filters).max(axis=1).sum(axis=0).max()) / 32_000, 1e-9)
        steps = np.round(filters / self.scale).astype(np.int16)
        self.parts = []
        for k in range(0, len(steps), 2):
            pair = steps[k][:, None, :] + (steps[k + 1][None] if k + 1 < len(steps) else np.zeros((1, 1, FILTERS), np.int16))
            width = min(2, len(steps) - k)
            rows = np.ascontiguousarray(pair.reshape(-1, FILTERS))
            self.parts.append((k, width, rows))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        total = None
        for k, width, rows in self.parts:
            index = windows[:, k : k + LENGTH] if width == 1 else (windows[:, k : k + LENGTH] << 6) | windows[:, k + 1 : k + 1 + LENGTH]
            part = rows.take(index.ravel(), axis=0).reshape(len(windows), LENGTH, FILTERS)
            total = part if total is None else np.add(total, part, out=total)
        return _pool(total) * self.scale


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Fit the network with Adam on windows dealt evenly over the languages."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    filters = [rng.normal(0, 0.3, (w, _CLASSES, FILTERS)) for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    values = [*filters, np.zeros(width), rng.normal(0, 0.2, (width, n)), np.zeros(n)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    of = [np.flatnonzero(labels == k) for k in range(n)]
    for step in range(1, steps + 1):
        y = rng.integers(0, n, BATCH)
        x = _padded(windows[[rng.choice(of[k]) for k in y]]).astype(np.int64)
        pooled, where = [], []
        for f in values[: len(WIDTHS)]:
            response = sum(f[k][x[:, k : k + LENGTH]] for k in range(len(f)))
            where.append(response.argmax(axis=1))
            pooled.append(np.take_along_axis(response, where[-1][:, None], axis=1)[:, 0])
        hidden = np.maximum(np.concatenate(pooled, axis=1) + values[-3], 0)
        logits = hidden @ values[-2] + values[-1]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        back = (p @ values[-2].T) * (hidden > 0)
        slopes = []
        for i, f in enumerate(values[: len(WIDTHS)]):
            g = np.zeros_like(f)
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            for k in range(len(f)):
                seen = np.take_along_axis(x, where[i] + k, axis=1)
                np.add.at(g[k], (seen, np.arange(FILTERS)[None]), own)
            slopes.append(g)
        slopes += [back.sum(axis=0), hidden.T @ p + 1e-4 * values[-2], p.sum(axis=0)]
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(values, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(languages, values[: len(WIDTHS)], values[-3], values[-2], values[-1])


def fit(
    df: DataFrame, key: str, learn: Column, text: str = "text", lang: str = "lang",
    slots: int = SLOTS, windows: int = WINDOWS, bounded: bool = False,
) -> Network | None:
    """Train on rows for which ``learn`` holds and the language is not null;
    None if there is no such row. ``bounded`` sets the network's bound."""
    rows = df.where(learn & F.col(lang).isNotNull() & F.col(key).isNotNull())
    mixed = F.xxhash64(key)
    slot = F.pmod(mixed, F.lit(slots))
    # at most ``slots`` rows for each language: fit to be broadcast and collected
    chosen = rows.groupBy(F.col(lang).alias("lang"), slot.alias("slot")).agg(F.min(F.struct(mixed.alias("h"), F.col(key).alias("id"))).alias("m"))
    chosen = chosen.select("lang", F.col("m.id").alias("id")).distinct()
    cuts = [
        F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.greatest(F.lit(1), F.length(text) - LENGTH)) + 1).cast("int"), F.lit(LENGTH))
        for k in range(windows)
    ]
    taken = rows.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.array(*cuts).alias("cuts"))
    sample = taken.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id").agg(F.min("cuts").alias("cuts")).collect()
    sample = sorted(((r["lang"], r["id"], [c for c in r["cuts"] or () if c]) for r in sample), key=lambda r: r[:2])
    languages = sorted({r[0] for r in sample if r[2]})
    if not languages:
        return None
    taught, kept_out, labels = [], [], []
    seen = dict.fromkeys(languages, 0)
    for name, _, texts in sample:
        if not texts:
            continue
        seen[name] += 1
        if bounded and seen[name] % 4 == 0:
            kept_out.append(texts)
            continue
        found, *_ = windows_of(*text_buffers(pa.array(texts, pa.string())))
        taught.append(found)
        labels.extend([languages.index(name)] * len(found))
    labels = np.array(labels)
    present = np.unique(labels)
    network = train(np.concatenate(taught), np.searchsorted(present, labels), [languages[k] for k in present])
    scores = [float(mean_probabilities(network, pa.array(["".join(texts)], pa.string())).max()) for texts in kept_out]
    return network._replace(bound=MARGIN * min(scores)) if scores else network


def mean_probabilities(network: Network, texts: pa.Array, tables: list | None = None) -> np.ndarray:
    """The probability of each language, by the mean over a text's windows."""
    windows, first, used = windows_of(*text_buffers(texts))
    logs = network.log_probabilities(windows, tables) * used[:, None]
    mean = np.add.reduceat(logs, first[:-1]) / np.maximum(np.add.reduceat(used, first[:-1]), 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _scorer(text: str, network, schema: pa.Schema):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        tables = net.tables()
        for piece in chunks(batches, text):
            p = mean_probabilities(net, piece.column(text), tables)
            values = {
                "lang_pred": pa.array([net.languages[k] for k in p.argmax(axis=1)], pa.string()),
                "score": pa.array(p.max(axis=1)),
            }
            columns = [values[f.name] if f.name in values else piece.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return score


def identify(df: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    df = df.drop("lang_pred", "score")
    unknown = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
    if network is None:
        return df.select("*", *unknown)
    letter = free_name(df, "__letter")
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    result = T.StructType([*df.schema.fields, T.StructField(letter, T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    network = df.sparkSession.sparkContext.broadcast(network)
    out = df.withColumn(letter, has_letter).mapInArrow(_scorer(text, network, to_arrow_schema(result)), result)
    chosen = [F.when(F.col(letter), F.col(c)).otherwise(u).alias(c) for c, u in zip(("lang_pred", "score"), unknown, strict=True)]
    return out.select(*df.columns, *chosen)
