"""Licence notices by a trained paragraph classifier.

Paragraphs of a text (lines, those joined that go on in the next one) become sparse counts of word 1- to 3-grams
that occur in licence notices. A multinomial logistic regression tells the licence families, other licences and
ordinary text apart; it is trained on the notices below, cut and blurred in many ways, against a bounded sample of
paragraphs of the corpus. Other licences are a class of their own, "unknown", learned from notices of families
that are not told apart. A temperature that is fitted on held-out examples calibrates the probabilities: a
paragraph that is no ordinary text, but where no family reaches ``SURE``, is "unknown" too. What is predicted is
then compared with the family's notices, and counts as confirmed where the shared 2-grams are enough.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Paragraphs of the licences and of the notices that name them, by family (SPDX identifiers in the comments).
NOTICES = {
    "mit": [  # MIT
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache": [  # Apache-2.0
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [  # GPL-2.0-or-later, GPL-3.0-or-later
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [  # LGPL-2.1-or-later, LGPL-3.0-or-later
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [  # AGPL-3.0-or-later
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [  # BSD-2-Clause, BSD-3-Clause
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [  # MPL-2.0
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [  # CC-BY-4.0
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [  # CC-BY-SA-4.0
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [  # CC-BY-NC-4.0
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc0": [  # CC0-1.0
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0.",
        "Licensed under CC0 1.0 Universal Public Domain Dedication.",
    ],
    "isc": [  # ISC
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced or distributed in any form without prior written permission of the publisher.",
        "All rights reserved.",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    UNKNOWN: [  # EPL-2.0, CDDL-1.0, EUPL-1.2, BSL-1.0, OFL-1.1, Artistic-2.0, Zlib, Unlicense
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "Licensed under the EUPL, Version 1.2 or later.",
        "Distributed under the Boost Software License, Version 1.0.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "This package is distributed under the terms of the Artistic License 2.0.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: EPL-2.0",
        "SPDX-License-Identifier: Zlib",
    ],
}
FAMILIES = ["none", *NOTICES]
#: A sampled paragraph with one of these words is left out of ordinary text: it may be a notice that is not known.
CUES = {"license", "licence", "licensed", "licences", "licenses", "copyright", "spdx", "warranty", "sublicense", "redistribute", "redistributions", "redistribution"}
#: Where a line does not end a sentence the next one goes on with it; marks of comments before a line are no words.
ENDS = tuple(".!?:")
WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Paragraphs of the corpus that training sees, at most.
SAMPLE = 4000
BLURS, EPOCHS, RATE, DECAY = 60, 60, 0.5, 1e-4
#: Pieces of each longer notice of a family that ordinary text quotes in training, and the words from which a notice is longer.
QUOTES, LONGER = 10, 12
SURE, ALIKE = 0.5, 0.5
#: 2-grams of a notice of few words.
FEW = 6
#: Of a notice so much stands in a paragraph that is confirmed, whatever part of the paragraph that is.
LEAST = 0.25
#: Every so many-th notice of the class "unknown" is kept from the model that the temperature is fitted with, and every so many-th example of the rest.
EVERY, EVERY_EXAMPLE = 3, 4
TEMPERATURES = (0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0)


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(tokens: list[str]) -> Counter:
    return Counter(" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1))


def pairs(tokens: list[str]) -> set[tuple[str, ...]]:
    return set(zip(tokens, tokens[1:]))


def kept_back(family: str, number: int, example: int) -> bool:
    """Whether calibration sees an example for the first time: whole licences of no family, and cut ones of the families, which no other notice could tell."""
    return number % EVERY == EVERY - 1 if family == UNKNOWN else example % EVERY_EXAMPLE == EVERY_EXAMPLE - 1


def examples(plain: list[str], seed: int = 5) -> tuple[list[list[str]], list[int], list[bool]]:
    """Token lists, classes, and which of them are kept back for calibration: the notices, whole, cut, with words lost and with neighbours around them; ordinary
    text, and ordinary text that quotes a few words of a notice."""
    rng = np.random.default_rng(seed)
    known = [pairs(words(n)) for ns in NOTICES.values() for n in ns]

    def is_ordinary(t: list[str]) -> bool:  # a sampled notice is no ordinary text
        have = pairs(t)
        return bool(t) and CUES.isdisjoint(t) and all(len(have & k) <= 0.4 * len(k) for k in known)

    ordinary = [t for t in map(words, plain) if is_ordinary(t)]
    around = ordinary or [["text"]]
    tokens, classes, back = [], [], []

    def add(part: list[str], family: int, held: bool) -> None:
        tokens.append(part)
        classes.append(family)
        back.append(held)

    for family, notices in NOTICES.items():
        for number, notice in enumerate(notices):
            whole = words(notice)
            for k in range(BLURS):
                part = whole
                if k and len(whole) > LONGER:
                    start = int(rng.integers(0, len(whole) // 3))
                    part = whole[start : start + int(rng.integers(len(whole) // 2, len(whole)))]
                if k % 3 == 1:
                    part = [w for w in part if rng.random() > 0.1]
                if k % 2:
                    other = around[int(rng.integers(len(around)))]
                    part = other[: int(rng.integers(0, 20))] + part + other[20 : 20 + int(rng.integers(0, 20))]
                add(part, FAMILIES.index(family), kept_back(family, number, k))
            for k in range(QUOTES if len(whole) > LONGER and family != UNKNOWN else 0):
                size = int(rng.integers(2, max(3, min(9, len(whole) // 3))))
                start = int(rng.integers(0, len(whole) - size))
                other = around[int(rng.integers(len(around)))]
                at = int(rng.integers(0, len(other) + 1))
                add(other[max(0, at - 12) : at] + whole[start : start + size] + other[at : at + 12], 0, k % EVERY_EXAMPLE == 0)
    for k, t in enumerate(ordinary):
        add(t, 0, k % EVERY_EXAMPLE == 0)
    return tokens, classes, back


def fit(plain: list[str]) -> dict:
    """vocabulary (gram: column), weights (columns x families, then the bias), temperature, and the words that matter.

    The temperature is that of a model that has not seen some licences of no family, nor some examples of the others, on these; the
    weights are then learned from all.
    """
    tokens, classes, back = examples(plain)
    counts = Counter(g for notices in NOTICES.values() for n in notices for g in grams(words(n)))
    vocabulary = {g: i for i, g in enumerate(sorted(counts))}
    size, rows, cols = len(vocabulary), [], []
    for r, t in enumerate(tokens):
        held = [vocabulary[g] for g in grams(t) if g in vocabulary]
        rows += [r] * len(held)
        cols += held
    rows, cols, y, back = np.array(rows), np.array(cols), np.array(classes), np.array(back)
    target = np.eye(len(FAMILIES))[y]

    def logits(w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), len(FAMILIES)))
        np.add.at(out, rows, w[cols])
        return out + w[-1]

    def learned(use: np.ndarray) -> np.ndarray:
        mass = np.bincount(y[use], minlength=len(FAMILIES))
        weight = np.where(use, 1 / np.maximum(mass, 1)[y] / len(FAMILIES), 0)
        weight[(y == 0) & use] *= len(FAMILIES) / 2  # ordinary text is the rule
        w, seen = np.zeros((size + 1, len(FAMILIES))), np.full((size + 1, len(FAMILIES)), 1e-8)
        uses = np.bincount(cols, minlength=size)
        for _ in range(EPOCHS):
            slope = (softmax(logits(w)) - target) * weight[:, None]
            step = np.zeros_like(w)
            np.add.at(step, cols, slope[rows])
            step[-1] = slope.sum(axis=0)
            step[:-1] += DECAY * w[:-1] * (uses > 0)[:, None] / max(size, 1)
            seen += step**2
            w -= RATE * step / np.sqrt(seen)
        return w

    z, want = logits(learned(~back))[back], y[back]
    # Classes count alike, however many examples they have.
    mass = 1 / np.bincount(want, minlength=len(FAMILIES))[want]
    losses = {t: (-np.log(softmax(z / t)[np.arange(len(z)), want] + 1e-12) * mass).sum() for t in TEMPERATURES}
    w = learned(np.ones(len(y), dtype=bool))
    # Without a gram that speaks for some family the bias decides, so such paragraphs need no features.
    lift = w[:-1, 1:].max(axis=1) - w[:-1, 0]
    matters = {word for g, i in vocabulary.items() if lift[i] > 0 for word in g.split()}
    return {"vocabulary": vocabulary, "weights": w, "temperature": min(losses, key=losses.get), "words": matters if softmax(w[-1][None])[0, 0] > SURE else None}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def likeness(tokens: list[str], family: str) -> float:
    """The share of the 2-grams of the family's best matching notice that stand in the paragraph; or of the paragraph's in the notice, if a part of the notice stands there (``LEAST``)."""
    have, best = pairs(tokens), 0.0
    for notice in NOTICES.get(family, []):
        held = pairs(words(notice))
        common = len(have & held)
        # Half of a notice of a few words are words that any text has: such a notice has to stand there whole.
        share = common / len(held) if common == len(held) or len(held) >= FEW else common / len(held) / 2
        best = max(best, share, common / len(have) if len(have) >= FEW and common >= LEAST * len(held) else 0.0)
    return best


def paragraphs(text: str | None) -> Iterator[list[tuple[int, int, str]]]:
    """The paragraphs of a text, as their lines: (number, start, line) each. Lines are joined with those that they go on in."""
    at, held = 0, []
    for k, line in enumerate((text or "").split("\n")):
        if line.strip():
            held.append((k, at, line))
        if held and (not line.strip() or line.rstrip().endswith(ENDS)):
            yield held
            held = []
        at += len(line) + 1
    if held:
        yield held


class Classifier:
    """Applies what :func:`fit` has learned."""

    def __init__(self, model: dict):
        self.vocabulary, self.weights, self.matters, self.temperature = model["vocabulary"], model["weights"], model["words"], model["temperature"]

    def of(self, lines: list[tuple[int, int, str]]) -> tuple | None:
        """(number, start, end, family, probability, likeness, confirmed, text) of lines that are a notice together, or None."""
        line = "\n".join(x for _, _, x in lines)
        tokens = words(line)
        if not tokens or self.matters is not None and self.matters.isdisjoint(tokens):
            return None
        held = [i for i in map(self.vocabulary.get, grams(tokens)) if i is not None]
        if not held:
            return None
        p = softmax(((self.weights[held].sum(axis=0) + self.weights[-1]) / self.temperature)[None])[0]
        if p[0] >= min(SURE, p[1:].max()):  # ordinary text is likelier than all others, or than any
            return None
        best = int(p[1:].argmax()) + 1
        family = FAMILIES[best] if p[best] >= SURE else UNKNOWN
        alike = likeness(tokens, family)
        return lines[0][0], lines[0][1], lines[-1][1] + len(lines[-1][2]), family, float(p[best]), alike, family != UNKNOWN and alike >= ALIKE, line

    def notices(self, text: str | None) -> Iterator[tuple]:
        """Paragraphs that are confirmed notices; of others the lines that are, and if none is, the whole again."""
        for lines in paragraphs(text):
            whole = self.of(lines)
            if len(lines) == 1 or whole and whole[6]:
                parts = [whole]
            else:
                parts = [x for line in lines if (x := self.of([line]))] or [whole]
            yield from (x for x in parts if x)


def train(docs: DataFrame) -> dict:
    """The model, from the notices and at most ``SAMPLE`` paragraphs of ``docs``, fitted in one task.

    The paragraphs are lines with the smallest hashes among all lines of all texts.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("p")).where("trim(p) <> ''")
    chosen = lines.orderBy(F.xxhash64("p"), "p").limit(SAMPLE)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([x for batch in batches for x in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return pickle.loads(chosen.coalesce(1).mapInArrow(learn, "model binary").first()["model"])


HITS = "paragraph int, start long, end long, family string, probability double, likeness double, confirmed boolean, text string"


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and ``HITS``: one row per paragraph, or line of one, that the model takes for a licence notice.

    ``paragraph`` is the number of its first line, ``start`` and ``end`` are code points. Null and empty texts have no paragraphs; repeated rows give their hits each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the notices

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            out = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for found in classifier.notices(text.as_py())]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "paragraph", "start", "end", "family", "probability", "likeness", "confirmed", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, " + HITS)
