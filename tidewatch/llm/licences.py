"""Licence scans: a trained classifier of stretches of paragraphs, confirmed by comparison with templates.

A paragraph is what stands between empty lines, so a notice that is wrapped over lines is one.  In it, wherever half or more of the word
pairs of one of ``TEMPLATES`` come close together, the stretch from the first to the last of them is a candidate; as
nothing else could be confirmed, nothing else is scored, and it does not matter how long the paragraph is or where in it a notice stands.

A candidate and the ``AROUND`` words on each side of it are scored by multinomial logistic regression on hashed words and pairs of words,
over licence families and a class of its own for what gives no licence.  The model is fitted on the driver to stretches made from the
templates (words dropped, put among other words), to the same denied (``DENIALS``) and to at most ``PLAIN`` stretches of the
corpus's own texts, which are of no licence; the probabilities are calibrated by a temperature on a part kept apart, and the least
probability that counts is set there so that at most ``FALSE_SHARE`` of plain stretches pass.  A candidate counts if
the classifier names the family of the template that it was found by, and the pairs are alike to ``ALIKE`` (twice those shared, by those of both).

Edge cases: a null or empty text has no paragraphs and no licence; texts are read whole, however long; of families equally probable in a text
the one that stands first is named; repeated rows each get a row; a null doc_id stays null; extra columns are ignored; an empty table
gives no rows (and the model is fitted to the templates alone).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, own_columns, rate_limit

PLAIN, PLAIN_TEXTS, LONGEST = 6000, 1500, 10_000
FALSE_SHARE = 1e-3
#: Share of a template's pairs that makes a candidate, and likeness that confirms one.
SHARED, ALIKE = 0.5, 0.5
#: Words between two pairs of a candidate, and words on each side of it that the classifier sees.
GAP, AROUND = 6, 6
BITS = 16
#: Stretches made from each template, and denied ones.
EACH, DENIED = 90, 60
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.05, 1e-4
UNKNOWN = "unknown"
REMEMBERED = 400_000
#: Public notices by which each family is declared.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal, dedicated to the public domain."],
}
#: Sentences that speak of licences without giving one.
DECOYS = [
    "He lost his driver's license on the way to work.", "The version of the software was released under great pressure.", "A general public meeting was held in the free state.", "The work permit and the fishing license are sold at the office.",
    "License plates are issued by the county.", "The lecture compares the MIT License with the Apache License, version 2.0, and the GNU General Public License.", "Permission to use the pool is granted by the office free of charge.",
]
#: What, put before a notice or after it, says that it does not hold; what speaks of a licence only; and what may stand there without harm.
DENIALS = ["this file is not", "this work is not", "the code was never", "it is no longer", "this isn't", "the parts below aren't", "nothing here is", "neither of them is", "the work cannot be", "we refuse to have it", "it must not be", "not", "nothing in this folder is", "neither part is", "none of the files was ever"]
DENIED_AFTER = ["does not apply here", "is not granted", "was withdrawn", "no longer applies"]
MENTIONS = ["the lecture compares", "unlike", "a short history of", "we read about", "he explained", "the difference from", "questions about", "a talk on"]
LEADS = ["this file is", "the code is", "all parts of this work are", "copyright the authors", "", "", "note", "the software is"]
WORD = re.compile(r"[^\W_]+")
BREAK = re.compile(r"\n[^\S\n]*\n")
TAIL = re.compile(r"[^\w\s]*")
FAMILIES = [*TEMPLATES, UNKNOWN]


def lowered(text: str) -> str:
    """The text in lower case, of the same length (only a dotted capital I would grow)."""
    return text.replace("\u0130", "i").lower()


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


#: The templates' words by number, from 1; their pairs as (first number * _N + second); the pairs of each template, and the templates of each pair.
_NUMBER: dict[str, int] = {}
for _texts in TEMPLATES.values():
    for _t in _texts:
        for _w in words_of(_t):
            _NUMBER.setdefault(_w, len(_NUMBER) + 1)
_N = len(_NUMBER) + 1


def _pairs(numbers: list[int]) -> list[int]:
    return [a * _N + b for a, b in zip(numbers, numbers[1:])]


SHOWN: list[tuple[int, set[int]]] = [(k, set(_pairs([_NUMBER[w] for w in words_of(t)]))) for k, texts in enumerate(TEMPLATES.values()) for t in texts]
_IN: dict[int, list[int]] = {}
for _i, (_, _ps) in enumerate(SHOWN):
    for _p in _ps:
        _IN.setdefault(_p, []).append(_i)
_KNOWN = np.zeros(_N * _N, bool)
_KNOWN[list(_IN)] = True


def candidates(words: list[str]) -> list[tuple[int, int, int, float]]:
    """(family, first word, one after the last, likeness) of each stretch that has enough of a template's pairs."""
    numbers = np.array([_NUMBER.get(w, 0) for w in words], np.int64)
    if len(numbers) < 2:
        return []
    pairs = numbers[:-1] * _N + numbers[1:]
    at = np.flatnonzero(_KNOWN[pairs])
    if len(at) < 2:
        return []
    found = []
    for group in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1):
        if len(group) < 2:
            continue
        by: dict[int, list[int]] = {}
        for p in group.tolist():
            for i in _IN[int(pairs[p])]:
                by.setdefault(i, []).append(p)
        for i, places in by.items():
            family, own = SHOWN[i]
            start = 0
            for k in range(1, len(places) + 1):  # a template's own places may lie further apart than the group's
                if k < len(places) and places[k] - places[k - 1] <= GAP + 1:
                    continue
                a, b = places[start], places[k - 1] + 2
                start = k
                here = set(pairs[a : b - 1].tolist())
                both = len(here & own)
                if both >= 2 and both >= SHARED * len(own):
                    found.append((family, a, b, 2 * both / (len(here) + len(own))))
    return found


class Model:
    def __init__(self, weights: np.ndarray, temperature: float, least: float) -> None:
        self.weights, self.temperature, self.least = weights, temperature, least
        self.known: dict[str, int] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        return np.array([known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode())) for w in words], np.uint64)

    def features(self, before: list[str], words: list[str], after: list[str]) -> np.ndarray:
        """The places of the words and of their pairs, and of the words on each side."""
        shift = np.uint64(32 - BITS)
        ids = self.ids(words)
        pairs = (ids[:-1] * np.uint64(0x9E3779B1) + ids[1:] * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
        return (np.concatenate([ids, pairs, self.ids([f"<{w}" for w in before]), self.ids([f">{w}" for w in after])]) >> shift).astype(np.int64)

    def probabilities(self, before: list[str], words: list[str], after: list[str]) -> np.ndarray:
        f = self.features(before, words, after)
        z = self.weights[f].sum(0) / math.sqrt(max(len(f), 1)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(family, start, end, probability) of the text's licence notices, in code points."""
        low = lowered(text)
        words = WORD.findall(low)
        if not candidates(words):
            return []
        found = []
        begin = 0
        for end in [*(m.start() for m in BREAK.finditer(low)), len(low)]:
            found += self.paragraph(low, begin, end)
            begin = end
        return found

    def paragraph(self, low: str, begin: int, end: int) -> list[tuple[str, int, int, float]]:
        at = [m.span() for m in WORD.finditer(low, begin, end)]
        words = [low[a:b] for a, b in at]
        good = []
        for family, a, b, alike in candidates(words):
            if alike < ALIKE:
                continue
            p = self.probabilities(words[max(0, a - AROUND) : a], words[a:b], words[b : b + AROUND])
            if int(p.argmax()) == family and p[family] >= self.least:
                good.append((family, a, b, float(p[family]), alike))
        kept: list[list] = []  # the likest first; others that overlap go, or make a notice of the same family longer
        for family, a, b, p, _ in sorted(good, key=lambda x: (-x[4], -x[3], x[1])):
            near = [k for k in kept if a < k[2] + (GAP if k[0] == family else 0) and k[1] < b + (GAP if k[0] == family else 0)]
            if not near:
                kept.append([family, a, b, p])
            elif len(near) == 1 and near[0][0] == family:
                near[0][1:] = min(near[0][1], a), max(near[0][2], b), max(near[0][3], p)
        return [(FAMILIES[k], at[a][0], TAIL.match(low, at[b - 1][1], end).end(), p) for k, a, b, p in sorted(kept, key=lambda x: x[1])]


Example = tuple[list[str], list[str], list[str], int]


def examples(plain: list[str], rng: np.random.Generator) -> tuple[list[Example], list[Example]]:
    """Words before, words, words after and class: those made from the templates, denied and mentioned ones too, and stretches of plain text."""
    filler = [w for line in plain[:400] for w in words_of(line)] or ["and", "of", "the"]
    none = len(TEMPLATES)
    some = lambda most: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, most + 1))]
    pick = lambda texts: words_of(texts[rng.integers(0, len(texts))])
    made, ordinary = [], []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            words = words_of(t)
            for i in range(EACH):
                own = [w for w in words if rng.random() > 0.08] if i else words
                lead = (some(6) if i % 2 else []) + (pick(LEADS) if i % 3 else [])
                made.append((lead[-AROUND:], own, some(6)[:AROUND] if i % 3 == 2 else [], k))
            for i in range(DENIED):
                own = [w for w in words if rng.random() > 0.08]
                last = i % 5 == 4
                lead = pick(LEADS) if last else pick(DENIALS) + (some(1) if i % 4 == 3 else [])
                inside = 0 if last or i % 3 else len(lead)  # a denial may stand within a stretch too
                made.append((lead[: len(lead) - inside][-AROUND:], lead[len(lead) - inside :] + own, pick(DENIED_AFTER)[:AROUND] if last else some(3), none))
            for _ in range(DENIED // 3):
                made.append(((some(3) + pick(MENTIONS))[-AROUND:], words[len(words) // 2 - 1 :], some(3) + ["and"], none))
    for t in DECOYS * 20:
        words = words_of(t)
        made.append(([], words, [], none))
        made += [(words[max(0, a - AROUND) : a], words[a:b], words[b : b + AROUND], none) for _, a, b, _ in candidates(words)]
    for line in plain:
        words = words_of(line)
        k = 0
        while k < len(words):  # stretches as long as notices, with what stands around them
            n = int(rng.integers(4, 30))
            if len(words[k : k + n]) > 1:
                ordinary.append((words[max(0, k - AROUND) : k], words[k : k + n], words[k + n : k + n + AROUND], none))
            k += n
    return made, [ordinary[i] for i in rng.permutation(len(ordinary))[:PLAIN]]


def train(plain: list[str]) -> Model:
    rng = np.random.default_rng(5)
    made, plain_ones = examples(plain, rng)
    first_plain, made = len(made), made + plain_ones
    model = Model(np.zeros((1 << BITS, len(FAMILIES))), 1.0, 0.5)
    rows = [model.features(*m[:3]) for m in made]
    labels = np.array([m[3] for m in made])
    order = rng.permutation(len(rows))
    apart, own = order[: len(order) // 5], order[len(order) // 5 :]
    m1, m2, t = np.zeros_like(model.weights), np.zeros_like(model.weights), 0
    for epoch in range(EPOCHS):
        own = rng.permutation(own)
        for k in range(0, len(own), BATCH):
            part = own[k : k + BATCH]
            f = np.concatenate([rows[d] for d in part])
            lengths = np.array([len(rows[d]) for d in part])
            scale = np.repeat(1 / np.sqrt(lengths), lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            z = np.add.reduceat(model.weights[f] * scale[:, None], starts)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            at, place = np.unique(f, return_inverse=True)
            each = np.repeat(p, lengths, axis=0) * scale[:, None] / len(part)
            grad = np.stack([np.bincount(place, each[:, c], len(at)) for c in range(len(FAMILIES))], axis=1) + DECAY * model.weights[at]
            t += 1
            m1[at] += 0.1 * (grad - m1[at])
            m2[at] += 0.01 * (grad * grad - m2[at])
            model.weights[at] -= RATE * (1 - epoch / EPOCHS) * m1[at] / (np.sqrt(m2[at]) + 1e-4)
    z = np.array([model.weights[rows[d]].sum(0) / math.sqrt(len(rows[d])) for d in apart])
    y = labels[apart]

    def loss(temperature: float) -> float:
        q = z / temperature
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    model.temperature = min((0.25 * 1.25**i for i in range(14)), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    p /= p.sum(1, keepdims=True)
    ordinary = apart >= first_plain
    wrong = np.sort(p[ordinary][:, :-1].max(1))
    model.least = max(0.5, float(wrong[min(len(wrong) - 1, int(len(wrong) * (1 - FALSE_SHARE)))])) if len(wrong) else 0.5
    return model


def fit(docs: DataFrame) -> Model:
    """Fits the model with lines of a bounded sample of ``docs``, those whose texts hash lowest, without words that speak of licences."""
    own = own_columns(docs, ("doc_id", "text")).where(F.length("text").between(1, LONGEST))
    some = lowest(own, rate_limit(docs.count(), PLAIN_TEXTS), "doc_id", "text").select("_low", "text").collect()
    texts = [text for _, text in sorted((r["_low"], r["text"]) for r in some)[:PLAIN_TEXTS]]
    told = re.compile(r"licen|copyright|creative commons|spdx|\bgnu\b|redistribut|hereby granted|public domain", re.I)
    plain = [line for text in texts for line in text.split("\n") if not told.search(line)]
    return train(plain[:PLAIN])


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, licence (the most probable family found, null if none), confidence, n_paragraphs (notices) and spans for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.temperature, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            found = [own.scan(t.as_py() or "") for t in b.column(1)]
            best = [max(x, key=lambda s: (s[3], -s[1]), default=None) for x in found]
            cols = [
                pa.array([x and x[0] for x in best], pa.string()), pa.array([x and x[3] for x in best], pa.float64()), pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(f"{f}:{s}:{e}" for f, s, e, _ in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "licence", "confidence", "n_paragraphs", "spans"])

    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, "doc_id bigint, licence string, confidence double, n_paragraphs bigint, spans string")
