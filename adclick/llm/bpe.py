"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged over, so between its bytes every encoding has a boundary. Texts are cut
there, each fragment is encoded on its own, once for each worker while its
cache lasts, and the ids are concatenated. Cuts are kept away from where they
could change how the tokenizer splits text before merging: inside a character,
after white space (a run of it depends on what follows), before an apostrophe
(contractions) and inside the text of an added token.

The tokenizer comes as the text of its file, of a fixed size, and is broadcast.
The pass is narrow: no shuffle, one text at a time beside a bounded cache.

Null is the empty text, which has no tokens. Texts that hold the string of an
added token get its id, as the library does by default. Other columns pass
through; the result columns replace older ones of the same names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from adclick.llm.words import Words, chunks, text_buffers

# Fragments a worker remembers before it starts anew.
CACHE_FRAGMENTS = 400_000

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ForcedBoundaryBPE:
    def __init__(self, file_text: str):
        self.tokenizer = Tokenizer.from_str(file_text)
        alphabet = byte_alphabet()
        added = json.loads(file_text)["added_tokens"]
        self.added = [t["content"].encode() for t in added]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)  # of each id
        inside = np.zeros(65536, bool)
        for token, number in vocabulary.items():
            own = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            self.bytes_of[number] = own
            if own not in self.added:
                codes = np.frombuffer(own, np.uint8).astype(np.int32)
                inside[codes[:-1] * 256 + codes[1:]] = True
        first = np.arange(65536) & 255
        last = np.arange(65536) >> 8
        space = np.isin(last, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
        continued = (first & 0xC0) == 0x80
        self.cut = ~inside & ~space & ~continued & (first != ord("'"))
        self.before_space = self.cut[np.arange(256) << 8 | 0x20].tobytes()
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.pool_at = np.cumsum(self.size_of) - self.size_of
        self.cache: dict[bytes, bytes] = {}

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a fragment begins at each byte."""
        begins = np.zeros(len(data) + 1, bool)
        wide = data.astype(np.uint16)
        begins[1:-1] = self.cut[(wide[:-1] << np.uint16(8)) | wide[1:]]
        if len(data) > 2:  # after white space above ASCII
            high = np.flatnonzero(begins[2:-1] & (data[1:-1] >= 0x80)) + 2
            before, last = data[high - 2], data[high - 1]
            two = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
            third = data[np.maximum(high - 3, 0)]
            three = (third >= 0xE1) & (third <= 0xE3) & (before >= 0x80) & (before < 0xC0)
            begins[high[two | three]] = False
        if self.added:
            blob = data.tobytes()
            for token in self.added:
                at = blob.find(token)
                while at >= 0:
                    begins[at + 1 : at + len(token)] = False
                    at = blob.find(token, at + 1)
        begins[offsets] = True
        return begins

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text begin and end."""
        starts = np.flatnonzero(self.boundaries(data, offsets)[:-1])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        words = Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), False)
        first, second = words.hashes(0), words.hashes(1)
        _, one, which = np.unique(first, return_index=True, return_inverse=True)
        if (second[one][which] != second).any():  # two fragments with one hash: tell them apart by both
            _, one, which = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
        blob = data.tobytes()
        distinct = [blob[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        ids = self._ids_of(distinct)
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        out = spans(pool, np.cumsum(sizes) - sizes, sizes, which)
        return out, np.concatenate([[0], np.cumsum(sizes[which])])[words.first]

    def _ids_of(self, fragments: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_FRAGMENTS:
            self.cache.clear()
        found = [self.cache.get(f) for f in fragments]
        new = [f for f, x in zip(fragments, found, strict=True) if x is None]
        if new:
            self._learn(new)
            found = [self.cache[f] if x is None else x for f, x in zip(fragments, found, strict=True)]
        return found

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode fragments, many in one call: where one may be cut from the
        next they can as well be joined, and the ids fall apart by their bytes."""
        runs: list[list[bytes]] = []
        joined = [f for f in fragments if f[0] == 0x20 and f[-1] < 0x80 and self.before_space[f[-1]]]
        joined = [f for f in joined if not any(token in f for token in self.added)]
        runs.extend(joined[i : i + 2000] for i in range(0, len(joined), 2000))
        rest = set(fragments).difference(joined) if len(joined) < len(fragments) else ()
        runs.extend([f] for f in rest)
        texts = [b"".join(run).decode() for run in runs]
        for run, encoded in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            if len(run) == 1:
                self.cache[run[0]] = ids.tobytes()
                continue
            reach = np.cumsum(self.size_of[ids])
            ends = np.cumsum([len(f) for f in run])
            last = np.searchsorted(reach, ends)
            if (reach[last] != ends).any():
                raise AssertionError("a token lies across a forced boundary")
            first = np.concatenate([[0], last[:-1] + 1])
            for fragment, low, high in zip(run, first.tolist(), (last + 1).tolist(), strict=True):
                self.cache[fragment] = ids[low:high].tobytes()

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The texts of the ids from each bound to the next. Bytes that are no
        character come as U+FFFD."""
        sizes = self.size_of[ids]
        blob = spans(self.pool, self.pool_at, self.size_of, ids).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        for low, high in zip(at, at[1:], strict=False):
            yield blob[low:high].decode("utf-8", "replace")


def spans(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of a pool, one after the other."""
    size = sizes[which]
    ends = np.cumsum(size)
    shift = np.repeat(at[which] - (ends - size), size)
    shift += np.arange(len(shift))
    return pool[shift]


_OWN: dict[str, ForcedBoundaryBPE] = {}


def _coder(file_text) -> ForcedBoundaryBPE:
    """One for each worker and broadcast."""
    if file_text.value not in _OWN:
        _OWN.clear()
        _OWN[file_text.value] = ForcedBoundaryBPE(file_text.value)
    return _OWN[file_text.value]


def _codes(text: str, file_text, wanted: Sequence[str], schema: pa.Schema):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(file_text)
        decodes = any(w.startswith("decoded") for w in wanted)
        for piece in chunks(batches, text):
            ids, bounds = coder.encode(*text_buffers(piece.column(text)))
            own = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
            decoded = list(coder.decode(ids, bounds)) if decodes else []
            blob = memoryview(ids.tobytes())
            make = {
                "n_tokens": lambda: pa.array(np.diff(bounds)),
                "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4"))),
                "ids_sha256": lambda: pa.array([hashlib.sha256(blob[4 * a : 4 * b]).hexdigest() for a, b in own], pa.string()),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            }
            values = {name: make[name]() for name in wanted}
            columns = [
                (values[f.name] if f.name in values else piece.column(f.name)).cast(f.type) for f in schema
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return codes


def encode_and_decode(df: DataFrame, path: str, text: str = "text", outputs: Sequence[str] = tuple(OUTPUTS)) -> DataFrame:
    """``df`` with the chosen ``OUTPUTS`` of its texts: the number of tokens, the
    ids, the text decoded from them, and digests of either."""
    with open(path, encoding="utf-8") as file:
        file_text = df.sparkSession.sparkContext.broadcast(file.read())
    df = df.drop(*outputs)
    result = T.StructType([*df.schema.fields, *[T.StructField(n, OUTPUTS[n]) for n in outputs]])
    return df.mapInArrow(_codes(text, file_text, tuple(outputs), to_arrow_schema(result)), result)
