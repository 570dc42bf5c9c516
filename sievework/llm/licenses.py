"""Licence scans by a trained paragraph classifier.

Paragraphs (lines) are cut into overlapping windows of ``SPAN`` words. A sparse logistic regression on hashed word n-grams tells
for each window whether it states a licence. In those that do, a second one names the family of each short stretch of
``STRETCH`` words; its classes include "unknown", trained on licences outside the families and on made-up names. A family stands
if its calibrated probability reaches ``least`` and the stretch matches one of the family's templates by the weight of common
n-grams; the words that it explains are taken out and the rest is looked at again, so a paragraph may state several. A window
without a family that stands is given as "unknown" if its gate probability is above 995
in 1000 of those of held-out other text, unless a neighbouring window names a family.

Training data are notices, short statements of the families' names, and ordinary sentences, all below, and a bounded sample of
the corpus as other text. Temperatures and ``least`` are set on notices and names that the fitted models have not seen, with
whole families outside the list held out for "unknown"; the models are then fitted on everything.

Null texts have no paragraphs; empty lines are none; repeated rows and null doc_ids are scanned like others; empty tables
give empty results and train without a sample.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, words as words_of
from .shingles import mix, word_chunks

SPAN = 16
STRETCH = 6
DIMS = 1 << 16
#: Lines of the corpus of which training takes a window as an example of other text: those with the least hashes.
SAMPLE_LINES = 1_500
SEED = 40_009
#: Share of the weight of a stretch's n-grams that a template must hold.
TEMPLATE_MATCH = 0.6
UNKNOWN = "unknown"

# fixed values: short licence notices in common use, by family
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the terms of the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Distributed under the MIT License. See LICENSE for more information."],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "This software is distributed under the 2-clause BSD license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU General Public License version 2.", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Released under the LGPL v3."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL v3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under CC BY-NC-SA 4.0.", "Released under the Creative Commons Attribution NonCommercial licence."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY-SA 3.0."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0", "This work is released into the public domain under the CC0 waiver."],
    "proprietary": ["All rights reserved.", "Copyright Example Corporation. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This document is proprietary and confidential. No part may be reproduced without written permission."],
}
# fixed values: names that short statements give a licence, by family
NAMES = {
    "Apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0", "Apache Software", "ALv2"],
    "MIT": ["MIT", "MIT/Expat", "MIT Expat", "Expat"],
    "BSD": ["BSD", "BSD 3-Clause", "BSD-2-Clause", "New BSD", "Modified BSD"],
    "GPL": ["GPL", "GPLv3", "GPLv2", "GNU GPL", "GPL-3.0", "GNU General Public"],
    "LGPL": ["LGPL", "LGPLv3", "LGPL-2.1", "GNU LGPL", "GNU Lesser General Public"],
    "AGPL": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL", "GNU Affero General Public"],
    "MPL": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public", "Mozilla"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-SA", "Creative Commons NonCommercial", "CC BY-NC-ND 4.0"],
    "CC-BY": ["CC BY", "CC BY 4.0", "CC-BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero"],
    "proprietary": [],
}
# fixed values: notices and names of licences of no family above, the last third of each held out when "unknown" is calibrated
OTHERS = ["Licensed under the Example Community Licence, version 1.", "Released under the Artistic License 2.0.", "This work is licensed under the Open Data Terms.", "Distributed under the terms of the ISC license.", "Licensed under the Boost Software License.", "SPDX-License-Identifier: Zlib", "Released under the Eclipse Public License.", "This file is licensed under the terms found in its header.", "Published under the European Union Public Licence.", "This font is licensed under the SIL Open Font License.", "Provided under the Unlicense.", "Use is subject to the licence terms of the vendor."]
OTHER_NAMES = ["ISC", "Zlib", "Boost Software", "Artistic", "Eclipse Public", "EUPL-1.2", "European Union Public", "Unlicense", "WTFPL", "Open Data Commons", "SIL Open Font", "PostgreSQL", "Python Software Foundation", "Microsoft Public", "CDDL", "Academic Free", "Open Government", "Reciprocal Source", "Community Share"]
# fixed values: short statements around a name
STATEMENTS = ["{} License", "License: {}", "Licence: {}", "Licensed under {}", "Released under the {} License.", "Licensed under the {} licence", "Distributed under the {} license.", "under the terms of the {} License", "Published under the {} Licence.", "Available under {}.", "Dual-licensed under the {} License", "Provided under the {}", "SPDX-License-Identifier: {}", "This project uses the {} license", "Copyright 2020 the authors, {} license"]
# fixed values: what made-up licences call themselves
KINDS = ["License", "Licence", "Public Licence", "Covenant", "Agreement", "Terms", "Waiver", "Software License"]
# fixed values: sentences that share words with notices
ORDINARY = ["The driver lost a licence for speeding last year.", "A version of the story was released under the title of the book.", "The permission of the owner is needed to enter the public park.", "Students at MIT work on free software and open problems.", "The general public was free to use the library.", "The terms of the work contract were published by the foundation.", "The Apache people live in the south.", "Conditions are met when the source is clean.", "He obtained a copy of the file and the documentation.", "The common version of the creative work is under review.", "This program was broadcast in two versions by the public network.", "You may use the form at the end of the page.", "The source code was written in a week.", "The goods were distributed under the bridge.", "All seats were reserved for the guests.", "She published the agreement under a false name.", "Under the new terms the work is paid by the hour.", "The album was released on vinyl in May.", "Rights and duties of tenants are set out below.", "The Mozilla building and the Boston library are open to the public."]


def _split(texts: list[str]) -> list[list[str]]:
    out = []
    for t in texts:
        out.append("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).lower().split())
    return out


def variants(notice: str, rng: np.random.Generator, n: int, around: list[str]) -> list[str]:
    """Notices with words left out, and with other words before and after them: what a corpus has."""
    words = notice.split()
    out = [notice]
    for _ in range(n - 1):
        w = [x for x in words if len(words) < 5 or rng.random() > 0.08] or words
        for side in (0, 1):
            if rng.random() < 0.5:
                more = list(rng.choice(around, rng.integers(1, 8)))
                w = w + more if side else more + w
        out.append(" ".join(w))
    return out


def features(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words and word pairs, first feature of each stretch and the end): stretches are bounds[i] to bounds[i + 1]."""
    one = (hashes & np.uint64(DIMS - 1)).astype(np.int32)
    two = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) & np.uint64(DIMS - 1)).astype(np.int32) if len(hashes) else one
    size = np.diff(bounds)
    total = np.where(size > 0, 2 * size - 1, 0)
    ends = np.append(0, np.cumsum(total))
    out = np.empty(ends[-1], np.int32)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(ends[:-1], size) + inner
    word = np.repeat(bounds[:-1], size) + inner
    out[at] = one[word]
    pair = inner < np.repeat(size - 1, size)
    out[(np.repeat(ends[:-1] + size, size) + inner)[pair]] = two[word[pair]]
    return out, ends


class Rows(NamedTuple):
    """A sparse matrix by rows: features and where each row begins; values are 1 by the root of the row's number of features."""

    features: np.ndarray
    ends: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    @property
    def values(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.diff(self.ends), 1))[self.owner]

    def take(self, rows: np.ndarray) -> Rows:
        """The rows where a flag is set."""
        return Rows(self.features[rows[self.owner]], np.append(0, np.cumsum(np.diff(self.ends)[rows])))

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.append(np.zeros((1, weights.shape[1])), np.cumsum(weights[self.features] * self.values[:, None], axis=0), axis=0)
        return total[self.ends[1:]] - total[self.ends[:-1]]


def _matrix(texts: list[str]) -> Rows:
    parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for _, hashes, at in word_chunks(pa.array(texts, pa.string()), signs_split=True):
        f, e = features(hashes, at)
        parts.append(f)
        ends.append(e[1:] + ends[-1][-1])
    return Rows(np.concatenate(parts), np.concatenate(ends))


def _joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.r_[a.features, b.features], np.r_[a.ends, b.ends[1:] + a.ends[-1]])


def fit(x: Rows, y: np.ndarray, classes: int, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression by accelerated gradient steps."""
    w, b = np.zeros((DIMS, classes)), np.zeros(classes)
    vw, vb = w.copy(), b.copy()
    share = np.bincount(y, minlength=classes)
    weight = (len(y) / classes / np.maximum(share, 1))[y][:, None]
    goal = np.eye(classes)[y]
    owner, values = x.owner, x.values
    for _ in range(steps):
        p = _softmax(x.times(w + 0.9 * vw) + b + 0.9 * vb)
        g = (p - goal) * weight / len(y)
        slope = np.stack([np.bincount(x.features, values * g[owner, c], DIMS) for c in range(classes)], axis=1)
        vw = 0.9 * vw - 4.0 * (slope + ridge * w)
        vb = 0.9 * vb - 4.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w.astype(np.float32), b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least held-out log loss."""
    grid = np.geomspace(0.2, 5, 40)
    return float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))


def grams(words: list[str]) -> list[tuple[str, ...]]:
    """Words and word pairs."""
    return [(w,) for w in words] + list(zip(words, words[1:], strict=False))


class Templates:
    """Word n-grams of the families' notices and names, weighted by how few families have them."""

    def __init__(self):
        self.of = {f: [set(grams(w)) for w in _split([*n, *(x.format(name) for name in NAMES[f] for x in STATEMENTS)])] for f, n in NOTICES.items()}
        have: dict[tuple, set] = {}
        for f, ts in self.of.items():
            for g in set().union(*ts):
                have.setdefault(g, set()).add(f)
        for w in _split([*OTHERS, *ORDINARY, *(x.format(name) for name in OTHER_NAMES for x in STATEMENTS)]):  # what others say too tells little
            for g in grams(w):
                have.setdefault(g, set()).add(UNKNOWN)
        self.weight = {g: math.log(len(self.of) / len(fs)) for g, fs in have.items()}
        self.own = {g for g, fs in have.items() if len(fs) == 1 and UNKNOWN not in fs}

    def match(self, words: list[str], family: str) -> tuple[float, float]:
        """(share of the n-grams' weight that the best template has, that weight); words that no notice has don't count."""
        found = {g for g in grams(words) if g in self.weight}
        total = sum(self.weight[g] for g in found)
        best = max((sum(self.weight[g] for g in found & t) for t in self.of.get(family, [])), default=0.0)
        return (best / total if total else 0.0), best

    def left(self, words: list[str], at: int, family: str) -> list[str]:
        """words without those of the stretch at a place that the family's templates hold, and without their pairs next to it."""
        known = set().union(*self.of[family])
        lo, hi = at, min(at + STRETCH, len(words))
        while lo and (words[lo - 1], words[lo]) in known:
            lo -= 1
        while hi < len(words) and (words[hi - 1], words[hi]) in known:
            hi += 1
        return words[:lo] + [w for w in words[lo:hi] if (w,) not in known] + words[hi:]


def statements(rng: np.random.Generator, made_up: int = 90) -> list[tuple[str, int, bool]]:
    """(short statement, family number, held out when calibrating): of the families' names, of others and of made-up ones."""
    out = []
    for k, names in enumerate([OTHER_NAMES, *NAMES.values()]):
        for i, name in enumerate(names):
            held = i >= 2 * len(names) // 3 if k == 0 else i % 4 == 3
            out += [(x.format(name), k, held) for x in STATEMENTS]
    for i in range(made_up):
        name = " ".join("".join(rng.choice(list("bcdfglmnprstv")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 4))).capitalize() for _ in range(rng.integers(1, 4)))
        out.append((f"{rng.choice(['Licensed', 'Released', 'Distributed', 'Published', 'Provided'])} under the {name} {rng.choice(KINDS)}", 0, i % 3 == 2))
    return out


class Model:
    """Both regressions, their calibration and the templates."""

    def __init__(self, lines: list[str], per_notice: int = 8):
        rng = np.random.default_rng(SEED)
        self.families = [UNKNOWN, *NOTICES]
        self.templates = Templates()
        filler = "copyright 2019 2024 the authors contributors see file for details www example org code text data this all by".split()
        plain_words = [w for x in [*ORDINARY, *lines] for w in x.split()]
        around = filler + list(rng.choice(plain_words, min(400, len(plain_words)), replace=False))
        # (text, family number, held out): whole notices and names are held out, not variants of what is trained on
        stated: list[tuple[str, int, bool]] = []
        for k, notices in enumerate([OTHERS, *NOTICES.values()]):
            for i, notice in enumerate(notices):
                held = i >= 2 * len(notices) // 3 if k == 0 else i % 4 == 3
                stated += [(v, k, held) for v in variants(notice, rng, per_notice, around)]
        stated += [(v, k, held) for x, k, held in statements(rng) for v in variants(x, rng, 2, around)]
        plain = [(v, i % 4 == 3) for i, s in enumerate(ORDINARY) for v in variants(s, rng, per_notice, plain_words)] + [(x, i % 4 == 3) for i, x in enumerate(lines) if x.strip()]
        xs, ys, held = _matrix([t for t, *_ in stated]), np.array([k for _, k, _ in stated]), np.array([h for *_, h in stated])
        xp, held_p = _matrix([t for t, _ in plain]), np.array([h for _, h in plain])
        flag = lambda a, b: np.r_[np.ones(a, int), np.zeros(b, int)]

        gate = fit(_joined(xs.take(~held), xp.take(~held_p)), flag((~held).sum(), (~held_p).sum()), 2)
        z, y = _joined(xs.take(held), xp.take(held_p)).times(gate[0]) + gate[1], flag(held.sum(), held_p.sum())
        self.gate_t = temperature(z, y)
        self.gate_accuracy = float((z.argmax(axis=1) == y).mean())
        # without a template to confirm it, a statement needs more than 995 in 1000 of held-out other text have
        self.least_unknown = float(min(0.98, max(0.5, np.quantile(_softmax(z / self.gate_t)[y == 0, 1], 0.995))))

        kind = fit(xs.take(~held), ys[~held], len(self.families))
        z = xs.take(held).times(kind[0]) + kind[1]
        self.kind_t = temperature(z, ys[held])
        p = _softmax(z / self.kind_t)
        # a family stands from the probability on that gets most held-out statements right, those of families never seen among them
        top, best = p.argmax(axis=1), p.max(axis=1)
        right = lambda least: (np.where(best >= least, top, 0) == ys[held]).mean()
        self.least = float(max(np.linspace(0.2, 0.95, 76), key=right))
        self.kind_accuracy = float(right(self.least))

        self.gate = fit(_joined(xs, xp), flag(len(held), len(held_p)), 2)
        self.kind = fit(xs, ys, len(self.families))

    def gate_scores(self, f: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability that each stretch of features states a licence."""
        w = self.gate[0][:, 1] - self.gate[0][:, 0]
        sums = np.append(0.0, np.cumsum(w[f], dtype=np.float64))
        n = np.diff(ends)
        z = (sums[ends[1:]] - sums[ends[:-1]]) / np.sqrt(np.maximum(n, 1)) + (self.gate[1][1] - self.gate[1][0])
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z / self.gate_t, -50, 50))), 0)

    def stated(self, words: list[str]) -> list[tuple[str, float, float]]:
        """(family, its probability, match with its templates) of all families that a window's words state."""
        out = []
        words = list(words)
        while words:
            spans = [words[i : i + STRETCH] for i in range(max(1, len(words) - STRETCH + 1))]
            p = _softmax((_matrix([" ".join(x) for x in spans]).times(self.kind[0]) + self.kind[1]) / self.kind_t)
            found = []
            for at, (span, row) in enumerate(zip(spans, p, strict=True)):
                k = int(row.argmax())
                if k and row[k] >= self.least and self.templates.own & set(grams(span)):
                    share, weight = self.templates.match(span, self.families[k])
                    if share >= TEMPLATE_MATCH and weight:
                        found.append((weight, float(row[k]), share, self.families[k], at))
            if not found:
                break
            _, q, share, name, at = max(found)
            if name not in [x[0] for x in out]:
                out.append((name, q, share))
            words = self.templates.left(words, at, name)
        return out


@functools.lru_cache(maxsize=2)
def _model(lines: tuple[str, ...]) -> Model:
    return Model(list(lines))


def windows(at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first word, end word) of the windows of lines with words at[i] to at[i + 1]: span words, half of them shared with the next."""
    size = np.diff(at)
    step = span // 2
    n = np.where(size <= span, 1, -(-(size - span) // step) + 1) * (size > 0)
    line = np.repeat(np.arange(len(size)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = at[:-1][line] + nth * step
    return line, first, np.minimum(first + span, at[1:][line])


def sampled_lines(docs: DataFrame, n: int) -> list[str]:
    """At most n distinct windows of SPAN words, one of each line anywhere in it: of the lines with the least hashes.

    Lines above a hash bound that leaves about 8 n are left out before any shuffle, so what is brought together stays small.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("t")).where("trim(t) <> ''").withColumn("h", F.xxhash64("t"))
    share = min(1.0, 8 * n / max(1, lines.count()))
    bound = min(2**63 - 1, -(2**63) + int(share * 2**64))
    w = words_of(F.col("t"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.size("w") - (SPAN - 1), F.lit(1))).cast("int") + 1
    found = lines.where(F.col("h") <= F.lit(bound).cast("long")).select("h", w.alias("w")).select("h", F.array_join(F.slice("w", start, F.lit(SPAN)), " ").alias("t"))
    return [r["t"] for r in found.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(n).collect()]


def scan(docs: DataFrame, gate: float = 0.5, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """doc_id, line, family, gate_probability, family_probability, template_match, text: one row per paragraph and licence it states."""
    texts = sampled_lines(docs, sample_lines)
    # a sampled window with n-grams that only notices have is no example of other text
    own = {g for g in Templates().own if len(g) > 1}
    sample = [t for t, w in zip(texts, _split(texts), strict=True) if not own & set(grams(w))]
    model = _model(tuple(sample))
    names = ["doc_id", "line", "family", "gate_probability", "family_probability", "template_match", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = pc.split_pattern(b.column(1).cast(pa.large_string()), "\n")
            flat, parent = split.flatten(), pc.list_parent_indices(split).to_numpy()
            if not len(flat):
                continue
            starts = np.searchsorted(parent, np.arange(b.num_rows))
            ids = b.column(0).to_pylist()
            rows: list[tuple] = []
            for first, hashes, at in word_chunks(flat, signs_split=True):
                line, s, e = windows(at)
                if not len(line):
                    continue
                # windows overlap: their words stand side by side for the features
                size = e - s
                place = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
                p = model.gate_scores(*features(hashes[place], np.append(0, np.cumsum(size))))
                hits = np.flatnonzero(p >= gate)
                for k in np.unique(line[hits]):
                    text = flat[first + int(k)].as_py()
                    words = _split([text])[0]
                    rows += [(ids[parent[first + k]], int(first + k - starts[parent[first + k]]) + 1, *r, text) for r in _line(model, words, [(int(w), float(p[w]), int(s[w] - at[k]), int(e[w] - at[k])) for w in hits[line[hits] == k]])]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(find, "doc_id long, line long, family string, gate_probability double, family_probability double, template_match double, text string")


def _line(model: Model, words: list[str], hits: list[tuple[int, float, int, int]]) -> list[tuple[str, float, float, float]]:
    """(family, gate probability, family probability, match) of a line's windows (number, gate probability, first word, end word) that state a licence."""
    best: dict[str, tuple] = {}
    named, unnamed = set(), []
    for w, p, s, e in hits:
        found = model.stated(words[s:e])
        for name, q, match in found:
            best[name] = max(best.get(name, (0.0, 0.0, 0.0)), (p, q, match))
        if found:
            named.add(w)
        else:
            unnamed.append((w, p))
    rest = [p for w, p in unnamed if p >= model.least_unknown and not named & {w - 2, w - 1, w + 1, w + 2}]
    if rest:
        best[UNKNOWN] = (max(rest), 0.0, 0.0)
    return [(name, *x) for name, x in sorted(best.items())]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
