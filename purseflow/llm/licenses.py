"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is what stands between lines without a word, so wrapped lines stay
together. Where it has a word pair of a template, the words around (a window of WINDOW
words at most) are read. Words and pairs of words are hashed to sparse features of a
multinomial logistic regression over licence families and an ``unknown`` class. It is
trained here by stochastic gradient descent: the templates below (names of licences,
openings and clauses of their texts), shortened, garbled and set amid other words, are
the families' examples; paragraphs of at most SAMPLE_DOCS documents, and templates cut
to a few words, are examples of unknown. On examples that training hasn't seen, a
temperature calibrates the shares, and the threshold for a family is set so that at most
FALSE_SHARE of the unknown ones get one. A found family is then compared with its
templates, long ones in parts of about CLAUSE words: the share of a template's word pairs
that the window holds must reach CONFIRMED. Then the words of that family's templates are taken out of the window and
the rest is read again, so that a paragraph can have several families.

A window without a telling word pair of a template (one that isn't of two FUNCTION
words) is unknown by definition, so only few windows are scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.llm.common import few_rows
from purseflow.llm.ngrams import Words, _mix, batches

WINDOW = 64
BUCKETS = 1 << 18
SAMPLE_DOCS = 400
SAMPLED_BYTES = 1 << 16  # longer texts are not drawn for training
EXAMPLES = 60  # of each template
CLAUSE = 20  # longer templates are compared in parts of about so many words
AROUND = 10  # words read on either side of a template's pairs
EPOCHS = 8
FALSE_SHARE = 0.001
CONFIRMED = 0.6
UNKNOWN = "unknown"
_BLANK = re.compile(r"\n\s*\n")

#: Words that say nothing of a licence when two of them follow each other.
FUNCTION = "a all an and any are as at be but by can each for from has have if in is it may no not of on only or other such that the their these this to under use which with you your".split()

#: Names of licences, and openings and clauses of their texts.
TEMPLATES = (
    ("MIT", "The MIT License"), ("MIT", "MIT License (MIT)"), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "distributed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "ISC License"), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "GNU General Public License"), ("GPL", "GNU General Public License, version 2"), ("GPL", "GNU GPL v3"), ("GPL", "GPL-3.0-or-later"), ("GPL", "GPL-2.0-only"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL", "GNU Lesser General Public License"), ("LGPL", "GNU LGPL"), ("LGPL", "LGPL-2.1-or-later"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "GNU Affero General Public License"), ("AGPL", "GNU AGPL"), ("AGPL", "AGPL-3.0"),
    ("AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "BSD 3-Clause License"), ("BSD", "BSD-2-Clause"), ("BSD", "the modified BSD license"), ("BSD", "governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "MPL 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "Eclipse Public License 2.0"), ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"), ("Zlib", "zlib License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY", "CC BY 4.0"), ("CC-BY", "Creative Commons Attribution 4.0 International"), ("CC-BY", "Creative Commons Attribution License"),
    ("CC-BY-SA", "CC BY-SA 4.0"), ("CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC-BY-SA", "Creative Commons Attribution-Share Alike License"),
    ("CC-BY-NC", "CC BY-NC 4.0"), ("CC-BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND", "CC BY-ND 4.0"), ("CC-BY-ND", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("public domain", "CC0 1.0 Universal"), ("public domain", "released into the public domain"), ("public domain", "dedicated to the public domain"),
    ("public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("public domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all rights reserved", "All rights reserved"), ("all rights reserved", "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher."),
)


def pairs_of(words: np.ndarray) -> np.ndarray:
    return _mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5) + np.uint64(1))


def features(words: np.ndarray) -> np.ndarray:
    """The buckets of a window's words and word pairs, each once."""
    return np.unique(np.concatenate([words, pairs_of(words)]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_hashes(text: str) -> np.ndarray:
    return np.concatenate([Words(group).hash for _, group in batches([text])])


@dataclass
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: list[tuple[str, np.ndarray]]  # family, hashes of word pairs
    pairs: np.ndarray  # telling ones of all templates, sorted

    def shares(self, window: np.ndarray) -> np.ndarray:
        found = features(window)
        x = (self.weights[found].sum(axis=0) / np.sqrt(max(1, len(found))) + self.bias) / self.temperature
        x = np.exp(x - x.max())
        return x / x.sum()

    def similarity(self, window: np.ndarray, family: str) -> float:
        mine = pairs_of(window)
        return max((float(np.isin(p, mine).mean()) for f, p in self.templates if f == family and len(p)), default=0.0)


    def families_in(self, window: np.ndarray):
        """(family, share, similarity) of each family in a window, the likeliest first; its templates' words are then taken out."""
        while len(window) > 1 and np.isin(pairs_of(window), self.pairs).any():
            p = self.shares(window)
            k = int(p[:-1].argmax())
            if p[k] < self.threshold:
                return
            family = self.families[k]
            yield family, float(p[k]), self.similarity(window, family)
            own = np.isin(pairs_of(window), np.concatenate([t for f, t in self.templates if f == family]))
            if not own.any():
                return
            window = window[~(np.r_[own, False] | np.r_[False, own])]


def _windows(n: int):
    return [(0, n)] if n <= WINDOW else [(at, min(n, at + WINDOW)) for at in range(0, n - WINDOW // 2, WINDOW // 2)]


def train(paragraphs: list[str], seed: int = 9) -> LicenseModel:
    rng = np.random.default_rng(seed)
    families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
    hashed = [(f, word_hashes(t)) for f, t in TEMPLATES]
    clauses = [(f, part) for f, w in hashed for part in np.array_split(w, max(1, len(w) // CLAUSE))]
    templates = [(f, np.unique(pairs_of(w))) for f, w in clauses]
    function = word_hashes(" ".join(FUNCTION))
    pairs = np.unique(np.concatenate([pairs_of(w)[~(np.isin(w[:-1], function) & np.isin(w[1:], function))] for _, w in hashed]))
    plain = [word_hashes(p) for p in paragraphs]
    plain = [w[a:b] for w in plain for a, b in _windows(len(w)) if b - a >= 2]
    plain = [w for w in plain if np.isin(pairs_of(w), pairs).sum() < 2]
    noise = np.concatenate(plain) if plain else rng.integers(1, 1 << 62, 4096).astype(np.uint64)
    some = lambda n: noise[(at := int(rng.integers(max(1, len(noise) - n)))) : at + n]
    sets: list[tuple[np.ndarray, int]] = []
    last = len(families) - 1
    for f, words in hashed:
        y = families.index(f)
        for k in range(EXAMPLES):
            w = words
            if k % 4:
                w = w[rng.random(len(w)) > (0.15 if len(w) > 12 else 0.05)]
            if len(w) > 16 and k % 3 == 0:
                cut = int(rng.integers(10, len(w) + 1))
                at = int(rng.integers(len(w) - cut + 1))
                w = w[at : at + cut]
            if k % 2:
                w = np.concatenate([some(int(rng.integers(0, 20))), w, some(int(rng.integers(0, 20)))])
            sets.append((features(w), y))
            if k % 8 == 0:  # a few of the words alone name no family
                bits = words[rng.permutation(len(words))[: int(rng.integers(1, max(2, len(words) // 4)))]]
                sets.append((features(np.concatenate([bits, some(int(rng.integers(5, 40)))])), last))
    sets += [(features(w), last) for w in plain]
    sets += [(features(some(int(rng.integers(3, 64)))), last) for _ in range(500)]
    order = rng.permutation(len(sets))
    unseen, seen = order[: len(sets) // 4], order[len(sets) // 4 :]
    w, b = np.zeros((BUCKETS, len(families))), np.zeros(len(families))
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(seen):
            found, y = sets[i]
            norm = np.sqrt(max(1, len(found)))
            x = w[found].sum(axis=0) / norm + b
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y] -= 1
            w[found] -= rate * p / norm
            b -= 0.05 * rate * p
    used = np.abs(w).max(axis=1) > 0.02  # sparse: the rest says too little
    w[~used] = 0
    model = LicenseModel(families, w, b, 1.0, 0.5, templates, pairs)
    y = np.array([sets[i][1] for i in unseen])
    raw = np.array([w[sets[i][0]].sum(axis=0) / np.sqrt(max(1, len(sets[i][0]))) + b for i in unseen])

    def softmax(x):
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    choice = np.geomspace(0.1, 4, 40)
    model.temperature = float(choice[int(np.argmin([-np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean() for t in choice]))])
    p = softmax(raw / model.temperature)
    wrong = np.sort(p[y == last, :-1].max(axis=1))
    if len(wrong):
        model.threshold = float(max(0.5, wrong[min(len(wrong) - 1, int((1 - FALSE_SHARE) * len(wrong)))]))
    model.weights = w.astype(np.float32)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> LicenseModel:
    """Train on the templates and on the paragraphs of ``sample`` documents at most,
    those with the smallest hashes of their ids."""
    known = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLED_BYTES)
    rows = few_rows(known, "doc_id", sample, 5).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return train([part for r in rows for part in _BLANK.split(r.text)])


def _spans(hit: np.ndarray, para: np.ndarray):
    """Stretches of words around hits that are near each other in one paragraph."""
    cut = np.flatnonzero((np.diff(hit) > AROUND) | (np.diff(para[hit]) > 0)) + 1
    for group in np.split(hit, cut):
        if len(group):
            first, end = np.searchsorted(para, [para[group[0]], para[group[0]] + 1])
            a, z = max(first, group[0] - AROUND), min(end, group[-1] + 2 + AROUND)
            for x, y in _windows(z - a):
                yield a + x, a + y


def _scan(shared):
    def run(batches_):
        model: LicenseModel = shared.value
        known = np.zeros(1 << 20, bool)
        known[(model.pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for b in batches_:
            ids = b.column("doc_id").to_pylist()
            out = {"doc_id": [], "paragraph": [], "family": [], "score": [], "similarity": [], "confirmed": []}
            before: dict[int, int] = {}  # paragraphs of a long text's earlier parts
            best: dict[tuple[int, int, str], tuple[float, float]] = {}
            for index, group in batches(b.column("text").to_pylist()):
                words = Words(group)
                if not len(words.hash):
                    continue
                text = np.searchsorted(words.begins, words.start, "right") - 1
                newline = np.cumsum(words.data == 10)[words.start]
                para = np.r_[0, np.cumsum((np.diff(newline) > 1) | (np.diff(text) > 0))]
                pair = pairs_of(words.hash)
                hit = np.flatnonzero(known[(pair & np.uint64((1 << 20) - 1)).astype(np.int64)])
                hit = hit[para[hit] == para[hit + 1]]
                hit = hit[np.isin(pair[hit], model.pairs)]
                start = {int(i): int(para[k]) for i, k in zip(*np.unique(text, return_index=True))}
                for a, z in _spans(hit, para):
                    i = int(text[a])
                    row = int(index[i])
                    no = int(para[a]) - start[i] + before.get(row, 0)
                    for family, share, similarity in model.families_in(words.hash[a:z]):
                        key = (row, no, family)
                        best[key] = max(best.get(key, (0.0, 0.0)), (similarity, share))
                for i, k in start.items():
                    before[int(index[i])] = before.get(int(index[i]), 0) + int(para[np.searchsorted(text, i, "right") - 1]) - k
            for (row, no, family), (similarity, share) in sorted(best.items()):
                for name, v in zip(out, (ids[row], no, family, share, similarity, similarity >= CONFIRMED)):
                    out[name].append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, paragraph, family, score, similarity, confirmed): a row for each family that
    the classifier finds in a paragraph, with its best window; ``paragraph`` counts the text's
    paragraphs that have a word, from 0. Null and empty texts give none, repeated rows give
    repeated rows, null ids come back as null, an empty table gives none, and other columns
    are not read. A text of over 1 MB is read in parts that are cut between words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(shared), "doc_id long, paragraph long, family string, score double, similarity double, confirmed boolean")
