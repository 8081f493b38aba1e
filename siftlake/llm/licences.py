"""Licence scans: a paragraph classifier of word n-grams, confirmed by comparison with templates.

Paragraphs are the blocks between blank lines (lines without letters or digits); words are runs of letters and digits,
A-Z taken as a-z and British spellings as American ones, so line breaks, comment marks and punctuation within a notice
don't matter. What is classified is a passage of a paragraph: a run of words, about as long as some template, that holds
LEAST_SEEDS of its 2-grams. All such passages are found by an index of the 2-grams, whatever the corpus is; where they
overlap, the one with most 2-grams goes first.

The features of a passage are the word 1-, 2- and 3-grams of the templates that it holds. Softmax regression with an L2
penalty learns the families, and an unknown class, from noised copies of the templates (words dropped, changed or put
around), from shuffles of their words, and from at most NEGATIVES lines of the corpus. A part that isn't fitted on
calibrates it: a temperature that makes the probabilities honest, and the least probability at which LEAST_PRECISION of
the predictions are right; below it a passage is unknown. A prediction stands if LEAST_SHARED of the words of one
template of its family occur in the passage in the template's order.

Cases: null and empty texts have no notices; repeated rows give repeated results; a null doc_id is kept; an empty corpus
trains on templates alone and gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import textkernel as tk
from siftlake.llm.sampling import least_hashed

#: Short notices of licence families, as their own texts recommend them or as they are commonly given.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Dedicated to the public domain under CC0 1.0 Universal."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "reserved": ["All rights reserved.", "Copyright the authors. All rights reserved. No part may be reproduced without permission."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
SIZES = (1, 2, 3)
NEGATIVES = 2_000
NEGATIVE_LETTERS = 2_000
COPIES = 60
PENALTY = 0.02
LEAST_PRECISION = 0.99
LEAST_SEEDS = 0.4
LEAST_SHARED = 0.7
SEED = 17
_BITS = 16
#: British spellings and their American forms.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "authorised": "authorized"}


def _plain_sequence(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = tk.words(raw, np.array([0, len(raw)]), tk.LETTERS)
    return tk.word_hashes(raw, starts, ends)


_SPELLED = sorted((int(_plain_sequence(k)[0]), int(_plain_sequence(v)[0])) for k, v in SPELLINGS.items())
_FROM, _TO = (np.array(x, np.uint64) for x in zip(*_SPELLED))


def _respelt(hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_FROM, hashes), len(_FROM) - 1)
    return np.where(_FROM[at] == hashes, _TO[at], hashes)


def word_sequence(text: str) -> np.ndarray:
    return _respelt(_plain_sequence(text))


def grams(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of the 1-, 2- and 3-grams of a word sequence."""
    return np.unique(np.concatenate([tk.window_hashes(words, n) for n in SIZES]))


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and paragraph of each word."""
    starts, ends, first = tk.words(data, offsets, tk.LETTERS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = (text[1:] != text[:-1]) | (line[1:] > line[:-1] + 1)
    return _respelt(tk.word_hashes(data, starts, ends)), text, np.cumsum(opens)


def in_order(template: list[int], words: list[int]) -> int:
    """The length of the longest common subsequence."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for k, w in enumerate(words):
            new.append(row[k] + 1 if w == t else max(new[k], row[k + 1]))
        row = new
    return row[-1]


class Passage(NamedTuple):
    first: int  # words
    end: int
    template: int
    pairs: int  # distinct 2-grams of the template


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # features by classes
    bias: np.ndarray
    temperature: float
    least: float
    templates: list[tuple[int, np.ndarray]]  # family and word hashes

    def __post_init__(self) -> None:
        own = [np.unique(tk.window_hashes(t, 2)) for _, t in self.templates]
        self.pairs = np.unique(np.concatenate(own))
        #: Which templates hold each 2-gram; of each template the 2-grams that a passage needs, and its greatest span.
        self.holds = np.array([np.isin(self.pairs, t) for t in own]).T
        self.needed = np.array([ceil(LEAST_SEEDS * len(t)) for t in own])
        self.span = np.array([len(t) + max(8, len(t) // 2) for t in own])
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.pairs >> np.uint64(64 - _BITS)] = True

    def ids(self, words: np.ndarray) -> np.ndarray:
        found = grams(words)
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == found]

    def classify(self, words: np.ndarray) -> tuple[int, float]:
        """The family and its probability; UNKNOWN if it's too improbable or no template confirms it."""
        z = (self.weights[self.ids(words)].sum(0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        family = int(p.argmax())
        if family != UNKNOWN and (p[family] < self.least or self.shared(family, words) < LEAST_SHARED):
            return UNKNOWN, float(p[family])
        return family, float(p[family])

    def shared(self, family: int, words: np.ndarray) -> float:
        return max(in_order(t.tolist(), words.tolist()) / len(t) for f, t in self.templates if f == family)

    def passages(self, hashes: np.ndarray, paragraph: np.ndarray) -> list[Passage]:
        """For each 2-gram that opens a passage of a template, that passage: up to where it has most of the template."""
        windows = tk.window_hashes(hashes, 2)
        at = np.flatnonzero(self.bitmap[windows >> np.uint64(64 - _BITS)])
        pair = np.minimum(np.searchsorted(self.pairs, windows[at]), len(self.pairs) - 1)
        good = (self.pairs[pair] == windows[at]) & (paragraph[at] == paragraph[at + 1])
        at, pair = at[good], pair[good]
        owner, template = np.nonzero(self.holds[pair])
        order = np.lexsort((at[owner], template))
        at, pair, template = at[owner][order], pair[owner][order], template[order]
        last = np.arange(len(at)) + self.needed[template] - 1
        end = np.minimum(last, len(at) - 1)
        near = lambda j: (template[j] == template) & (paragraph[at[j]] == paragraph[at]) & (at[j] - at < self.span[template])
        out = []
        for i in np.flatnonzero((last < len(at)) & near(end)).tolist() if len(at) else ():
            seen: set[int] = set()
            best, j = Passage(0, 0, int(template[i]), 0), i
            while j < len(at) and template[j] == template[i] and at[j] - at[i] < self.span[template[i]] and paragraph[at[j]] == paragraph[at[i]]:
                seen.add(int(pair[j]))
                if len(seen) > best.pairs:
                    best = Passage(int(at[i]), int(at[j]) + 2, best.template, len(seen))
                j += 1
            if best.pairs >= self.needed[best.template]:
                out.append(best)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, family, probability) of each notice."""
        hashes, text, paragraph = paragraphs(data, offsets)
        found = self.passages(hashes, paragraph)
        taken = np.zeros(len(hashes), bool)
        for p in sorted(found, key=lambda p: (-p.pairs, p.end - p.first, p.first, p.template)):
            if not taken[p.first : p.end].any():
                # a word on either side may belong to the notice without a 2-gram of it
                a = p.first - (p.first > 0 and paragraph[p.first - 1] == paragraph[p.first] and not taken[p.first - 1])
                b = p.end + (p.end < len(hashes) and paragraph[p.end] == paragraph[p.end - 1] and not taken[p.end])
                family, probability = self.classify(hashes[a:b])
                if family != UNKNOWN:
                    taken[p.first : p.end] = True
                    yield int(text[p.first]), family, probability


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(rows: list[np.ndarray], y: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by accelerated gradient descent on dense presence (templates have few n-grams)."""
    x = np.zeros((len(rows), features + 1), np.float32)
    for k, ids in enumerate(rows):
        x[k, ids] = 1
    x[:, -1] = 1
    target = np.eye(UNKNOWN + 1, dtype=np.float32)[y]
    weight = (1 / np.bincount(y, minlength=UNKNOWN + 1).clip(1))[y].astype(np.float32)[:, None]
    weight /= weight.sum()
    w = np.zeros((features + 1, UNKNOWN + 1), np.float32)
    velocity, step = np.zeros_like(w), 4.0 / max(float((x * x).sum(1).max()), 1.0)
    for _ in range(300):
        ahead = w + 0.9 * velocity
        gradient = x.T @ (weight * (_softmax(x @ ahead) - target)) + PENALTY / len(rows) * ahead
        velocity = 0.9 * velocity - step * gradient
        w = w + velocity
    return w[:-1].astype(float), w[-1].astype(float)


def _examples(rng: random.Random, negatives: list[list[str]]) -> tuple[list[list[str]], list[int]]:
    words = {f: [_split(t) for t in TEMPLATES[f]] for f in FAMILIES}
    every = sorted({w for ts in words.values() for t in ts for w in t})
    fill = [w for n in negatives for w in n] or ["lorem", "ipsum", "dolor"]
    texts, y = [], []
    for k, f in enumerate(FAMILIES):
        for t in words[f]:
            for copy in range(COPIES):
                out = [w if copy == 0 or rng.random() > 0.03 else rng.choice(fill) for w in t if copy == 0 or rng.random() > 0.06]
                if copy % 3 == 1:
                    out = rng.sample(fill, min(len(fill), rng.randint(1, 8))) + out
                if copy % 3 == 2:
                    out = out + rng.sample(fill, min(len(fill), rng.randint(1, 8)))
                texts.append(out)
                y.append(k)
                texts.append(rng.sample(every, min(len(every), len(t))))
                y.append(UNKNOWN)
                texts.append(rng.sample(t, len(t) // 3) + rng.sample(fill, min(len(fill), 4)))
                y.append(UNKNOWN)
    return texts + negatives, y + [UNKNOWN] * len(negatives)


def _split(text: str) -> list[str]:
    raw = text.encode()
    starts, ends, _ = tk.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tk.LETTERS)
    return [raw[a:b].decode().lower() for a, b in zip(starts, ends)]


def train(documents: DataFrame) -> Model:
    lines = documents.select(F.explode(F.split("text", "\n", -1)).alias("line")).where((F.length("line") > 0) & (F.length("line") <= NEGATIVE_LETTERS))
    sample = [r.line for r in least_hashed(lines, ["line"], NEGATIVES, distinct=True).collect()]
    templates = [(k, word_sequence(t)) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    vocabulary = np.unique(np.concatenate([grams(t) for _, t in templates]))
    model = Model(vocabulary, np.zeros((len(vocabulary), UNKNOWN + 1)), np.zeros(UNKNOWN + 1), 1.0, 0.0, templates)
    # A line that may be a notice is no example of the unknown class.
    alone = lambda w: not model.passages(w, np.zeros(len(w), np.int64))
    negatives = [_split(x) for x in sorted(sample) if alone(word_sequence(x))]
    rng = random.Random(SEED)
    texts, y = _examples(rng, negatives)
    rows = [model.ids(word_sequence(" ".join(t))) for t in texts]
    fitted = np.array([rng.random() < 0.75 for _ in texts])
    y = np.array(y)
    model.weights, model.bias = _fit([r for r, k in zip(rows, fitted) if k], y[fitted], len(vocabulary))
    rest = [k for k in range(len(texts)) if not fitted[k]]
    z = np.array([model.weights[rows[k]].sum(0) + model.bias for k in rest])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(rest)), y[rest]] + 1e-12).mean()
    model.temperature = min((0.05 * 1.25**k for k in range(30)), key=loss)
    p = _softmax(z / model.temperature)
    guess, top = p.argmax(1), p.max(1)
    known = guess != UNKNOWN
    order = np.argsort(-top[known])
    right = np.cumsum((guess == y[rest])[known][order]) / np.arange(1, known.sum() + 1)
    good = np.flatnonzero(right >= LEAST_PRECISION)
    model.least = float(top[known][order][good[-1]]) if len(good) else 1.0
    return model


def licences(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_notices, families (sorted, comma-joined) and confidence (the greatest probability) of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tk.slices(batch, "text"):
                found: list[list[tuple[int, float]]] = [[] for _ in range(high - low)]
                for text, family, p in sent.value.scan(data, offsets):
                    found[text].append((family, p))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([",".join(sorted({FAMILIES[f] for f, _ in x})) for x in found], pa.string()),
                        pa.array([max((p for _, p in x), default=0.0) for x in found], pa.float64()),
                    ],
                    ["doc_id", "n_notices", "families", "confidence"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_notices long, families string, confidence double")


def op6_licences(documents: DataFrame) -> DataFrame:
    return licences(documents, train(documents))
