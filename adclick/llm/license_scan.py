"""Licence statements in documents, wherever in a paragraph they stand.

Lines up to one without words are a paragraph, so a statement may be wrapped. A
multinomial logistic regression on word one- and two-grams, counted over the
root of the length, tells licence families from each other and from
``unknown``. It is trained in numpy on variants of the family's template
sentences (words dropped, other words around them) and, for ``unknown``, on a
bounded sample of the corpus' own lines and on template words out of order; a
temperature fitted on variants that the training has not seen calibrates the
probabilities.

A statement is looked for where a template is: each two-gram of a template
opens a window, which has the template's length or goes on to the last of its
two-grams within twice that length. Where a window has enough of the
template's two-grams, and the network gives it the template's family, the
family is stated there. So neither a paragraph's length nor another statement
in it counts. Of statements that overlap the likeliest stands.

Words are looked up in a table of a few hundred hashes, and only windows are
classified. It is a narrow pass over whole texts, without a shuffle.

Places and ``n_paragraphs`` count lines: a statement is at the line in which it
begins, and a line has a family once. Null and empty texts have none; lines
without words state nothing. A document may hold several families; repeated
rows give equal results. Other columns pass through; the result columns replace
older ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from adclick.llm.words import ALNUM, Words, chunks, mix, scan

UNKNOWN = "unknown"
SLOTS = 1500  # documents whose paragraphs are sampled, one each
SAMPLE_CHARS = 2000
VARIANTS = 25  # of each template
CONFIRM = 0.6  # share of a template's two-grams
WHOLE = 3  # so many two-grams, or fewer, are needed all
BOUND = 0.5  # least calibrated probability
STEPS = 200
CELL = 64  # words; statements are looked up by it

# Usual sentences, short forms and identifiers by which a work is
# put under a licence.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU AGPL v3",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": ["Released under CC0 1.0 Universal.", "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
        "Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License.",
        "GNU General Public License",
        "GNU GPL v3",
        "GNU GPL v2",
        "licensed under the GPL",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
        "ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "GNU Lesser General Public License",
        "GNU LGPL v3",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
        "MIT License",
        "MIT licensed",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": ["All rights reserved.", "Copyright by the author. All rights reserved."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable",
        "SPDX-License-Identifier: Zlib",
    ],
}


def grams(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one-grams and of two-grams within a paragraph, and their
    paragraphs; ``owner`` ascends."""
    same = owner[1:] == owner[:-1]
    two = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    return np.concatenate([hashes, two]), np.concatenate([owner, owner[1:][same]])


class Vocabulary:
    """The n-grams of the templates, and what each template consists of."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.families = [UNKNOWN, *sorted(templates)]
        owned = [(self.families.index(f), t) for f in sorted(templates) for t in templates[f]]
        words = scan(pa.array([t for _, t in owned]), ALNUM, lower=True)
        found, row = grams(words.hashes(), words.text_of())
        self.hashes = np.unique(found)
        self.texts = owned
        n = len(words.starts)
        self.pairs = [(f, np.unique(found[n:][row[n:] == k])) for k, (f, _) in enumerate(owned)]

    def counts(self, words: Words, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, feature) of every known n-gram, and the words of each."""
        found, row = grams(words.hashes(), owner)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[at] == found
        return row[known], at[known], np.bincount(owner, minlength=n)


def needed(pairs: np.ndarray) -> int:
    """How many of a template's distinct two-grams confirm it."""
    return len(pairs) if len(pairs) <= WHOLE else int(np.ceil(CONFIRM * len(pairs) - 1e-9))


class Model(NamedTuple):
    weights: np.ndarray  # n-grams by families
    offset: np.ndarray
    temperature: float


def _matrix(vocabulary: Vocabulary, texts: Sequence[str]) -> np.ndarray:
    words = scan(pa.array(texts, pa.string()), ALNUM, lower=True)
    row, feature, size = vocabulary.counts(words, words.text_of(), len(texts))
    out = np.zeros((len(texts), len(vocabulary.hashes)))
    np.add.at(out, (row, feature), 1.0)
    return out / np.sqrt(np.maximum(size, 1))[:, None]


def _variants(vocabulary: Vocabulary, paragraphs: Sequence[str], seed: int) -> tuple[list[str], np.ndarray]:
    """Labelled training paragraphs."""
    rng = np.random.default_rng(seed)
    filler = [w for p in paragraphs for w in p.split()] or ["word"]
    texts, labels = [], []
    for family, text in vocabulary.texts:
        own = text.split()
        for k in range(VARIANTS):
            # an identifier or a short form is nothing without one of its words
            kept = [w for w in own if k == 0 or len(own) <= WHOLE or rng.random() > 0.1]
            before, after = ([filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 7) if k % 3 else 0)] for _ in "ab")
            texts.append(" ".join([*before, *kept, *after]))
            labels.append(family)
            # words as the scan sees them: an identifier falls apart
            words = re.findall("[0-9A-Za-z]+", text)
            loose = [words[i] for i in rng.permutation(len(words))[: rng.integers(1, 1 + max(1, len(words) // 2))]]
            texts.append(" ".join([*loose, *after, *before]))
            labels.append(0)
    texts.extend(paragraphs)
    labels.extend([0] * len(paragraphs))
    return texts, np.array(labels)


def train(vocabulary: Vocabulary, paragraphs: Sequence[str]) -> Model:
    """Fit on variants around the given paragraphs, which are of no family."""
    clean = [p for p in paragraphs if not confirmed(vocabulary, p, range(1, len(vocabulary.families)))]
    texts, y = _variants(vocabulary, clean, 5)
    x = _matrix(vocabulary, texts)
    n = len(vocabulary.families)
    weights, offset = np.zeros((x.shape[1], n)), np.zeros(n)
    hot = np.eye(n)[y]
    share = 1 / np.maximum(np.bincount(y, minlength=n), 1)[y]  # families weigh alike
    share /= share.sum()
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros(n), np.zeros(n)]
    for step in range(1, STEPS + 1):
        p = _softmax(x @ weights + offset)
        slope = (p - hot) * share[:, None]
        for value, g, m, s in ((weights, x.T @ slope + 1e-5 * weights, *moments[:2]), (offset, slope.sum(axis=0), *moments[2:])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    texts, y = _variants(vocabulary, clean, 6)
    logits = _matrix(vocabulary, texts) @ weights + offset
    steps = np.geomspace(0.5, 8, 40)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in steps]
    return Model(weights, offset, float(steps[int(np.argmin(losses))]))


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def confirmed(vocabulary: Vocabulary, text: str, families: Sequence[int]) -> bool:
    """Whether a template of one of the families is in the paragraph."""
    words = scan(pa.array([text], pa.string()), ALNUM, lower=True)
    found, _ = grams(words.hashes(), words.text_of())
    own = set(found[len(words.starts) :].tolist())
    return any(
        len(pairs) and len(own.intersection(pairs.tolist())) >= needed(pairs) for f, pairs in vocabulary.pairs if f in families
    )


class Statement(NamedTuple):
    low: int  # words
    high: int
    family: int
    score: float
    begin: int  # the first word of its two-grams


class Search:
    """Statements among words, found window by window."""

    def __init__(self, vocabulary: Vocabulary, model: Model):
        self.vocabulary, self.model = vocabulary, model
        # every two-gram of every template: hash, template, place in it
        rows = []
        self.sizes, self.need = [], []
        for k, (family, text) in enumerate(vocabulary.texts):
            words = scan(pa.array([text]), ALNUM, lower=True)
            pairs, _ = grams(words.hashes(), words.text_of())
            rows += [(h, k, place) for place, h in enumerate(pairs[len(words.starts) :].tolist())]
            self.sizes.append(len(words.starts))
            self.need.append(needed(vocabulary.pairs[k][1]))
        rows.sort()
        self.pairs = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.known: dict[bytes, tuple[int, float]] = {}

    def windows(self, two: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, its two-gram, first word, end) of windows with enough two-grams of the
        template; ``two`` is the hash of each word and the next, 0 at an end."""
        low = np.searchsorted(self.pairs, two)
        count = np.searchsorted(self.pairs, two, side="right") - low
        at = np.repeat(np.arange(len(two)), count)
        entry = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        template, place, value = self.template[entry], self.place[entry], two[at]
        for k, (size, need) in enumerate(zip(self.sizes, self.need, strict=True)):
            mine = np.flatnonzero(template == k)
            # a two-gram may stand at two places of its template
            here, spot, gram = at[mine], place[mine], value[mine]
            ends = np.searchsorted(here, here + 2 * size - 1)
            for j in np.flatnonzero((need > 0) & (ends - np.arange(len(here)) >= need)).tolist():
                found = here[j : ends[j]]
                if len(np.unique(gram[j : ends[j]])) < need:
                    continue
                first = max(int(here[j] - spot[j]), 0)
                yield k, int(found[0]), first, int(found[-1]) + 2
                short = found < here[j] - spot[j] + size - 1
                if len(np.unique(gram[j : ends[j]][short])) >= need:
                    yield k, int(found[0]), first, int(here[j] - spot[j]) + size

    def judged(self, hashes: np.ndarray) -> tuple[int, float]:
        key = hashes.tobytes()
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            found, _ = grams(hashes, np.zeros(len(hashes), np.int64))
            at = np.minimum(np.searchsorted(self.vocabulary.hashes, found), len(self.vocabulary.hashes) - 1)
            at = at[self.vocabulary.hashes[at] == found]
            logits = self.model.weights[at].sum(axis=0) / np.sqrt(len(hashes)) + self.model.offset
            p = _softmax((logits / self.model.temperature)[None])[0]
            self.known[key] = int(p.argmax()), float(p.max())
        return self.known[key]

    def statements(self, hashes: np.ndarray, owner: np.ndarray) -> list[Statement]:
        """Statements in the order of words; ``owner`` is each word's paragraph."""
        if len(hashes) < 2:
            return []
        same = owner[1:] == owner[:-1]
        two = np.where(same, mix(hashes[:-1] * np.uint64(3) + hashes[1:]), np.uint64(0))
        found = set()
        begin = np.searchsorted(owner, owner)
        end = np.searchsorted(owner, owner, side="right")
        for k, anchor, low, high in self.windows(two):
            low, high = max(low, int(begin[anchor])), min(high, int(end[anchor]))
            own = np.flatnonzero(np.isin(two[low : high - 1], self.vocabulary.pairs[k][1]))
            if len(np.unique(two[low + own])) < self.need[k]:
                continue
            family, score = self.judged(hashes[low:high])
            if family == self.vocabulary.texts[k][0] and family > 0 and score >= BOUND:
                found.add(Statement(low, high, family, score, low + int(own[0])))
        # the likeliest first; those that overlap one of another family go
        kept: list[Statement] = []
        taken: dict[int, list[Statement]] = {}
        for s in sorted(found, key=lambda s: (-s.score, s.low, s.high, s.family)):
            near = [t for cell in range(s.low // CELL, s.high // CELL + 1) for t in taken.get(cell, ())]
            if not any(t.low < s.high and s.low < t.high for t in near):
                kept.append(s)
                for cell in range(s.low // CELL, s.high // CELL + 1):
                    taken.setdefault(cell, []).append(s)
        return sorted(kept)


def sample_paragraphs(df: DataFrame, key: str, text: str = "text") -> list[str]:
    """One paragraph of at most SLOTS documents, at places given by hashes."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    rows = df.where(F.col(key).isNotNull())
    chosen = rows.groupBy(slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("id"))).alias("m"))
    chosen = chosen.select(F.col("m.id").alias("id"))  # one row a slot: small
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    place = F.pmod(F.xxhash64(key, F.lit(9)), F.size(lines)).cast("int")
    # the lines beside it tell whether it is part of a wrapped statement
    around = F.slice(lines, F.greatest(place - 1, F.lit(1)), 5)
    cut = [F.substring(x, 1, SAMPLE_CHARS).alias(n) for x, n in ((F.get(lines, place), "line"), (F.array_join(around, "\n"), "around"))]
    taken = rows.select(F.col(key).alias("id"), *cut).join(F.broadcast(chosen), "id")
    found = taken.groupBy("id").agg(F.min(F.struct("line", "around")).alias("m")).select("m.*").collect()
    vocabulary = Vocabulary()
    every = range(1, len(vocabulary.families))
    return sorted(r["line"] for r in found if r["line"] and not confirmed(vocabulary, r["around"], every))


def fit(df: DataFrame, key: str, text: str = "text") -> Model:
    return train(Vocabulary(), sample_paragraphs(df, key, text))


_SPAN = T.StructType(
    [
        T.StructField("paragraph", T.IntegerType()),
        T.StructField("family", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_ADDED = [("n_paragraphs", T.LongType()), ("licenses", T.ArrayType(_SPAN))]


def _scanner(text: str, model, schema: pa.Schema):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(Vocabulary(), model.value)
        for piece in chunks(batches, text):
            words = scan(piece.column(text), ALNUM, lower=True)
            data, offsets = words.data, words.offsets
            # a line ends with its line feed, or with the text
            begins = np.zeros(len(data) + 1, bool)
            begins[1:] = data == 0x0A
            begins[offsets[:-1]] = True
            begins[len(data)] = True
            starts = np.flatnonzero(begins)
            first = np.searchsorted(starts[:-1], offsets)
            line = np.searchsorted(starts, words.starts, side="right") - 1
            row = words.text_of()
            # a paragraph begins after a line without words
            apart = (line[1:] > line[:-1] + 1) | (row[1:] != row[:-1])
            owner = np.concatenate([[0], np.cumsum(apart)])[: len(line)]
            lists: list[list] = [[] for _ in range(piece.num_rows)]
            best: dict[tuple[int, int], float] = {}
            for s in search.statements(words.hashes(), owner):
                at = int(line[s.begin]), s.family
                best[at] = max(best.get(at, 0.0), s.score)
            for (at, family), score in best.items():
                text_row = int(np.searchsorted(first, at, side="right")) - 1
                lists[text_row].append({"paragraph": at - int(first[text_row]), "family": search.vocabulary.families[family], "score": score})
            values = {"n_paragraphs": pa.array(np.diff(first), pa.int64()), "licenses": pa.array(lists, schema.field("licenses").type)}
            columns = [(values[f.name] if f.name in values else piece.column(f.name)).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return find


def scan_licenses(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_paragraphs`` and ``licenses``: paragraph, family and
    calibrated score of each confirmed statement, in order."""
    df = df.drop(*[n for n, _ in _ADDED])
    result = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in _ADDED]])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(_scanner(text, shared, to_arrow_schema(result)), result)
