"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by comparison with templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, with_results

_AS_IS = "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."

#: Paragraphs of licences and notices by family and version, as authors put them into their works.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "Released under the GNU General Public License.",
        "This is free software, licensed under the GPL.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, " + _AS_IS,
    ),
    "bsd-2-clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "isc": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "zlib": ("Released under the zlib License.", "This software is provided as-is, without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", _CC.format("Attribution")),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike")),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial")),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives")),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "proprietary": ("All rights reserved.", "Copyright 2020 the company. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "This file is proprietary and confidential."),
}
#: Sentences that speak of licences, versions and permission without granting or keeping one.
OTHERS = ("You need a license to drive a car in this country.", "The work of the author is free of charge.", "This version of the software is released in public.", "Permission to enter the library is granted to any person with a card.", "The general public may use the source of the river.", "Copies of this file are in the library.", "He was licensed as a pilot under the terms of the law.", "The conditions of the contract are met.", "Version 3 of the program works with source and binary forms of text.", "All seats are reserved.", "The rights of all people are in the law.", "We compare the MIT license with the Apache license in this chapter.", "The foundation has published a new license for software.")
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_ENDS = (".", "!", "?", ":")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def paragraphs(text: str) -> Iterator[list[str]]:
    """The words of each paragraph: lines are joined until one without words, or the end of a sentence at a line's end."""
    joined: list[str] = []
    for line in text.split("\n"):
        if words := words_of(line):
            joined += words
        if joined and (not words or line.rstrip().endswith(_ENDS)):
            yield joined
            joined = []
    if joined:
        yield joined


def samples(plain: list[str], copies: int = 40, seed: int = 11) -> list[tuple[list[str], str]]:
    """Labelled paragraphs: notices with words left out, cut off or put among other words, and paragraphs without one."""
    rng = random.Random(seed)
    pool = [words_of(p) for p in plain if p] + [words_of(p) for p in OTHERS]
    filler = [w for p in pool for w in p] or ["a"]
    out = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            base = words_of(notice)
            for i in range(copies):
                w = [x for x in base if i < 5 or len(base) < 6 or rng.random() > 0.04]
                if len(w) >= 12 and rng.random() < 0.4:  # part of a long one, from its start or up to its end
                    n = rng.randint(max(8, len(w) // 3), len(w))
                    w = w[:n] if rng.random() < 0.7 else w[-n:]
                if rng.random() < 0.5:
                    w = rng.choices(filler, k=rng.randint(0, 25)) + w + rng.choices(filler, k=rng.randint(0, 25))
                out.append((w, family))
    parts = [x for notices in TEMPLATES.values() for n in notices for x in words_of(n)]
    for i in range(copies * 80):
        w = list(rng.choice(pool)) if i % 3 else rng.choices(filler, k=rng.randint(1, 60))
        if i % 4 == 0:
            w += rng.choices(parts, k=rng.randint(1, 6))  # stray words of notices
        rng.shuffle(w) if i % 5 == 0 else None
        out.append((w, UNKNOWN))
    rng.shuffle(out)
    return out


@dataclass
class LicenceModel:
    """Multinomial logistic regression over word 1- and 2-grams; most weights are zero."""

    families: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5  # of the probability of being known
    words: frozenset = field(init=False)
    pairs: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self):
        self.words = frozenset(w for g in self.index for w in g.split(" "))
        self.pairs = {tuple(g.split(" ")): i for g, i in self.index.items() if " " in g}

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        ids = {i for w in words if (i := get(w)) is not None}
        pair = self.pairs.get
        ids |= {i for ab in zip(words, words[1:], strict=False) if (i := pair(ab)) is not None}
        return self.bias + self.weights[sorted(ids)].sum(axis=0) if ids else self.bias

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self.scores(words) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, words: list[str], others: float = 0.05) -> list[tuple[str, float]]:
        """The families of at least `others` probability, likeliest first; none if the unknown class keeps too much."""
        p = self.probabilities(words)
        if 1 - p[0] < self.threshold:
            return []
        return [(self.families[i], float(p[i])) for i in np.argsort(-p, kind="stable").tolist() if i and (p[i] >= others or p[i] == p[1:].max())]


class _Rows:
    """Sparse rows of ones: products with a matrix of weights, and the transposed product."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width, self.n = width, len(rows)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.column = np.array([i for r in rows for i in r], np.int64)
        self.order = np.argsort(self.column, kind="stable")
        self.row = np.repeat(np.arange(self.n), np.diff(self.at))[self.order]
        self.starts = np.searchsorted(self.column[self.order], np.arange(width))

    @staticmethod
    def _sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        return total[ends] - total[starts]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.column], self.at[:-1], self.at[1:])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g[self.row], self.starts, np.append(self.starts[1:], len(self.row)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: list[tuple[list[str], str]], steps: int = 100, penalty: float = 2e-4, false_rate: float = 0.002, missed: float = 0.02) -> LicenceModel:
    """Fit on four fifths; on the last fifth choose the temperature (likelihood) and the threshold of the unknown class:
    in the middle, by log odds, between what `false_rate` of the paragraphs without a notice pass and what `missed` of the
    others fall short of; the former if it is higher."""
    cut = len(labelled) * 4 // 5
    families = [UNKNOWN, *sorted({y for _, y in labelled} - {UNKNOWN})]
    counts: dict[str, int] = {}
    for w, _ in labelled[:cut]:
        for g in set(ngrams(w)):
            counts[g] = counts.get(g, 0) + 1
    names = sorted(g for g, n in counts.items() if n >= 5)
    index = {g: i for i, g in enumerate(names)}
    x = _Rows([sorted(index[g] for g in set(ngrams(w)) if g in index) for w, _ in labelled[:cut]], len(names))
    y = np.zeros((x.n, len(families)))
    y[np.arange(x.n), [families.index(k) for _, k in labelled[:cut]]] = 1
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    step_w, step_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(steps):
        g = (_softmax(x.times(w) + b) - y) / x.n
        gw, gb = x.transposed_times(g), g.sum(axis=0)
        step_w += gw**2
        step_b += gb**2
        rate = 0.3 / np.sqrt(step_w)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty)  # the penalty sets weights to zero
        b = b - 0.3 / np.sqrt(step_b) * gb
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    model = LicenceModel(families, {names[i]: k for k, i in enumerate(used)}, w[used], b)
    held = [(model.scores(k), families.index(f)) for k, f in labelled[cut:]]
    z, at = np.array([s for s, _ in held]), np.array([f for _, f in held])

    def loss(t: float) -> float:
        return float(-np.log(_softmax(z / t)[np.arange(len(at)), at] + 1e-300).mean())

    model.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    p = np.clip(_softmax(z / model.temperature)[:, 0], 1e-12, 1 - 1e-12)
    odds = np.log1p(-p) - np.log(p)  # of being known
    if (at == 0).any() and (at > 0).any():
        wrong, right = np.quantile(odds[at == 0], 1 - false_rate), np.quantile(odds[at > 0], missed)
        model.threshold = float(1 / (1 + np.exp(-max(wrong, (wrong + right) / 2))))
    return model


_PAIRS = {f: [set(zip(w, w[1:], strict=False)) for w in map(words_of, t)] for f, t in TEMPLATES.items()}


def agreement(words: list[str], family: str) -> tuple[float, int]:
    """The best of the family's templates: the share of its word pairs that the paragraph has, or of the paragraph's (6 words or
    more) that it has, and how many pairs these are."""
    pairs = set(zip(words, words[1:], strict=False))
    best = (0.0, 0)
    for t in _PAIRS[family]:
        common = len(pairs & t)
        share = max(common / len(t), common / len(pairs) if len(words) >= 6 else 0.0)
        best = max(best, (share, common))
    return best


def confirms(words: list[str], family: str, least: float = 0.6) -> bool:
    return agreement(words, family)[0] >= least


def judge_paragraph(words: list[str], model: LicenceModel, least: float = 0.6) -> tuple[str, float] | None:
    """The family that the classifier predicts and a template confirms; among versions it cannot tell apart, the one whose
    template agrees in the most pairs (then with the larger share, then the likelier one)."""
    found = [(*agreement(words, f), p, f) for f, p in model.predict(words)]
    found = [(common, share, p, f) for share, common, p, f in found if share >= least]
    return max(found)[:-3:-1] if found else None


def find_licences(text: str, model: LicenceModel) -> tuple[int, list[tuple[int, str, float]]]:
    """The number of paragraphs of the text, and (paragraph, family, probability) of the confirmed ones."""
    n, hits = 0, []
    known = model.words
    for words in paragraphs(text):
        # Without a word of any known n-gram the score is the bias, which is the unknown class.
        if not known.isdisjoint(words) and (found := judge_paragraph(words, model)):
            hits.append((n, *found))
        n += 1
    return n, hits


def scan_licences(df: DataFrame, model: LicenceModel, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Add n_paragraphs, n_licensed, families (sorted, comma-joined) and licences (array of paragraph, family, probability).

    Null and empty texts have no paragraphs. Whole texts are read, however long; repeated rows are judged alike; ties between
    families go to the more probable, then to the last by name. Other columns are kept, equal names replaced. No shuffle; the
    model (some thousand weights) goes along with the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> list[list]:
        rows = []
        for t in texts:
            n, hits = find_licences(t.decode("utf-8", "replace"), shared.value)
            rows.append((n, len(hits), ",".join(sorted({f for _, f, _ in hits})), [{"paragraph": i, "family": f, "probability": p} for i, f, p in hits]))
        return [list(c) for c in zip(*rows, strict=True)]

    return with_results(df, text, "n_paragraphs long, n_licensed long, families string, licences array<struct<paragraph: int, family: string, probability: double>>", compute, keep)


def default_model(plain: DataFrame, text: str = "text", most: int = 500) -> LicenceModel:
    """Trained on the templates and on at most `most` texts (a documented bound), those of the least hashes, of a table without notices."""
    body = F.col(f"`{text}`")
    return train(samples([r[0] for r in plain.select(body).distinct().orderBy(F.xxhash64(body), body).limit(most).collect()]))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), default_model(table(spark, sf_dir, "benchmark")), keep=["doc_id"])
