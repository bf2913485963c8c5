"""Licence families of paragraphs by a trained classifier, confirmed against templates.

A paragraph is a line. It is judged in windows of ``WINDOW`` words that start every ``STEP`` words, so a licence
sentence counts wherever it stands in a long line. The words, word pairs and word triples of a window are hashed
to sparse features; logistic regression, trained here on altered and embedded template sentences and on
other text, gives a score for each family and for ``unknown``. Sums over windows are differences of running
sums, so their overlap costs nothing. Scores become probabilities by a temperature fitted on held-out windows, and
a window goes on if it is known with the probability that held-out unknown windows reach in at most ``PASSING``
of cases. The ``TRIED`` likeliest families, likeliest first, are then compared with the line around the window: some
stretch must share ``CONFIRMED`` of the word pairs of a template (or of a shorter line), hold all its telling words, which
name a family or a version, and no family word of another licence. Of equally likely families the first by
the order of ``NAMES`` is tried first.

Defined cases: null and empty texts have no paragraphs and no licences. Rows are judged one by one,
whatever their ids. Only the id and the text are read, so other columns may have any name. A licence or a version
that no template names is no licence here. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.words import ALPHANUMERIC, ngrams, slices, split_words

BUCKETS = 1 << 14
LINES, SEED = 9000, 11  # the labelled windows that the classifier is fitted on
PASSING, CONFIRMED = 0.05, 0.6
WINDOW, STEP = 32, 16
TRIED = 3
SLACK, BESIDE = 6, 2  # foreign words inside a stretch, and words beside it that may tell
UNKNOWN = "unknown"

# Names of public licences, the usual notices with them, and sentences of their texts.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "mit": ["MIT License", "MIT/X11 license"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPLv3 license"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2", "GPLv2 license"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3 license"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3 license"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-clause BSD license", "three-clause BSD license"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-clause BSD license", "two-clause BSD license"],
    "bsd": ["BSD-style license"],
    "isc": ["ISC License"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0 license"],
    "cc0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
NOTICES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.",
    "This work is licensed under a {}.", "This project is licensed under the terms of the {}.", "is available under the {}",
]
SENTENCES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-2.1": [
        "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "bsd-3-clause": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd-2-clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "cc-by-4.0": ["SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4.0": ["SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-4.0": ["SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd-4.0": ["SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc-sa-4.0": ["SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nc-nd-4.0": ["SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
}
# Words that name a family; numbers of versions tell too.
FAMILY_WORDS = {
    "apache", "mit", "gnu", "gpl", "lgpl", "agpl", "lesser", "library", "affero", "bsd", "isc", "mozilla", "mpl", "creative", "cc", "cc0", "zero",
    "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "three", "two",
}
TEMPLATES = {family: [form.format(name) for name in names for form in NOTICES] + SENTENCES[family] for family, names in NAMES.items()}
# Lines that speak of licences without being one.
DECOYS = [
    "A driver's license is required to rent a car.", "The license of the software was discussed at the meeting.", "He works under a commercial license agreement with the vendor.",
    "The city issued a new fishing license under the law.", "Please read the terms and conditions of service before use.", "All rights reserved.", "Copyright 2021 by the authors.",
    "This work was published by the university press, version 3.", "Free software is discussed in this article.", "The foundation released its annual report under a new title.",
    "Permission to film was granted free of charge by the mayor.", "The public can use the library without restriction.",
]


def _numbers(words: np.ndarray, n: int) -> np.ndarray:
    """Feature number of the n-gram at each word."""
    return (ngrams(words, np.array([0, len(words)]), n)[0] & np.uint64(BUCKETS - 1)).astype(np.int64)


def windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of all windows of lines that begin at ``firsts``; the last one of a line ends with it."""
    sizes = np.diff(firsts)
    many = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STEP) + 1, sizes > 0)
    line = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
    starts = firsts[line] + np.minimum(nth * STEP, np.maximum(sizes[line] - WINDOW, 0))
    return starts, np.minimum(starts + WINDOW, firsts[line + 1]), line


_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def word_list(line: str) -> list[str]:
    """Words as ``split_words`` divides them, the v of a version taken off."""
    return [re.sub(r"^v(?=\d)", "", w) for w in _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), line))]


def tells(word: str) -> bool:
    return word in FAMILY_WORDS or (word != "0" and any("0" <= c <= "9" for c in word))


@dataclass
class Template:
    size: int
    pairs: set[tuple[str, str]]
    telling: set[str]
    others: set[str]  # family words of other licences


def _template(sentence: str) -> Template:
    words = word_list(sentence)
    return Template(len(words), set(zip(words, words[1:], strict=False)), {w for w in words if tells(w)}, FAMILY_WORDS - set(words) - {"library", "three", "two"})


_COMPARED = {family: [_template(t) for t in sentences] for family, sentences in TEMPLATES.items()}


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray  # (families, BUCKETS)
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.05

    def scores(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the windows from ``starts`` to ``ends``."""
        sums, found = np.zeros((len(starts), len(self.names))), np.zeros(len(starts))
        for n in (1, 2, 3):
            numbers = _numbers(words, n)
            low = np.minimum(starts, len(numbers))
            high = np.maximum(np.minimum(ends - n + 1, len(numbers)), low)
            found += high - low
            for k in range(len(self.names)):
                running = np.concatenate([np.zeros(1), np.cumsum(self.weights[k][numbers])])
                sums[:, k] += running[high] - running[low]
        return sums / np.sqrt(np.maximum(found, 1))[:, None] + self.bias

    def chances(self, scores: np.ndarray) -> np.ndarray:
        scaled = scores / self.temperature
        grown = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return grown / grown.sum(axis=1, keepdims=True)

    def calibrate(self, scores: np.ndarray, told: np.ndarray) -> None:
        """Temperature by likelihood, then the least probability by what unknown lines reach."""
        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(np.maximum(self.chances(scores)[np.arange(len(told)), told], 1e-12)).mean()

        self.temperature = min((0.05 * 1.25**k for k in range(24)), key=loss)
        unknown = self.names.index(UNKNOWN)
        reached = 1 - self.chances(scores)[told == unknown][:, unknown]
        self.least = max(0.05, float(np.quantile(reached, 1 - PASSING)))


def sample_lines(count: int, seed: int) -> list[tuple[str, str]]:
    """(line, family): altered template sentences, alone or among other words of a window; decoys and other text."""
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ti", "es", "ou", "ch", "ei", "ê", "ü", "la", "de", "ing", "tion"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    known = [w for lines in TEMPLATES.values() for line in lines for w in line.split()]
    out = []
    for _ in range(count):
        if rng.random() < 0.5:
            family = rng.choice(list(TEMPLATES))
            words = rng.choice(rng.choice([TEMPLATES, SENTENCES])[family]).split()
            if len(words) > 8 and rng.random() < 0.3:
                words = [w for w in words if any(map(tells, word_list(w))) or rng.random() > 0.08]
            line, room = " ".join(words), max(WINDOW - len(words), 0)
            before = rng.randint(0, room)
            embedded = f"{prose(before, before)} {line} {prose(room - before, room - before)}".strip()
            line = rng.choice([line, line, line.upper(), embedded, embedded, embedded, f"# {line}", f"Copyright (c) {rng.randint(1990, 2030)} {prose(1, 2)}. {line}"])
            out.append((line, family))
        else:
            line = rng.choice([lambda: prose(1, WINDOW), lambda: prose(WINDOW, WINDOW), lambda: rng.choice(DECOYS), lambda: f"{prose(0, 20)} {rng.choice(DECOYS)} {prose(0, 4)}", lambda: " ".join(rng.choice(known) for _ in range(rng.randint(1, 12)))])()
            out.append((line, UNKNOWN))
    return out


_fitted: dict[str, Classifier] = {}


def fit(spark: SparkSession, lines: int = LINES, seed: int = SEED) -> Classifier:
    """Fitted on three quarters of the sample lines and calibrated on the rest, once for each application."""
    key = f"{spark.sparkContext.applicationId}/{lines}/{seed}"
    if key in _fitted:
        return _fitted[key]
    names = [*TEMPLATES, UNKNOWN]
    sample = sample_lines(lines, seed)
    words, firsts = split_words(pa.array([line for line, _ in sample], pa.large_string()), ALPHANUMERIC)
    grams = [_numbers(words, n) for n in (1, 2, 3)]
    told = np.array([names.index(f) for _, f in sample])
    held = np.arange(len(sample)) % 4 == 3
    table = []
    for k in np.flatnonzero(~held).tolist():
        own = np.concatenate([g[firsts[k] : max(firsts[k + 1] - n, firsts[k])] for n, g in enumerate(grams)])
        at, seen = np.unique(own, return_counts=True)
        table.append((Vectors.sparse(BUCKETS, at.tolist(), (seen / np.sqrt(max(seen.sum(), 1))).tolist()), float(told[k])))
    data = spark.createDataFrame(table, ["features", "label"]).repartition(4).cache()
    model = LogisticRegression(family="multinomial", maxIter=25, regParam=1e-4, standardization=False).fit(data)
    data.unpersist()
    made = Classifier(names, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    made.calibrate(made.scores(words, firsts[:-1], firsts[1:])[held], told[held])
    _fitted[key] = made
    return made


def confirmed(words: list[str], family: str) -> bool:
    """Whether some stretch of the words is a template of the family, with its telling words and no other family's."""
    pairs = list(zip(words, words[1:], strict=False))
    for template in _COMPARED[family]:
        least = max(CONFIRMED * min(len(template.pairs), len(set(pairs))), min(3, len(template.pairs)))
        places = [i for i, pair in enumerate(pairs) if pair in template.pairs]
        for at, first in enumerate(places):
            common = set()
            for last in places[at:]:
                if last - first > template.size + SLACK:
                    break
                common.add(pairs[last])
                if len(common) >= least:
                    near = set(words[max(first - BESIDE, 0) : last + 2 + BESIDE])
                    if template.telling <= near and not near & template.others:
                        return True
    return False


def scan(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_licence_paragraphs, licences) of every row; licences are sorted family names."""
    model = model or fit(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unknown = model.names.index(UNKNOWN)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 19):
            lines = pc.split_pattern(texts, "\n")
            flat = lines.flatten().cast(pa.large_string())
            owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy())
            words, firsts = split_words(flat, ALPHANUMERIC)
            filled = np.bincount(owner, np.diff(firsts) > 0, len(texts)).astype(np.int64)
            starts, ends, line = windows(firsts)
            chances = model.chances(model.scores(words, starts, ends))
            counts, found = np.zeros(len(texts), np.int64), [set() for _ in range(len(texts))]
            at, listed, licensed = -1, [], False
            for w in np.flatnonzero(1 - chances[:, unknown] >= model.least).tolist():
                if line[w] != at:
                    at, listed, licensed = line[w], word_list(flat[int(line[w])].as_py()), False
                around = listed[max(starts[w] - firsts[at] - WINDOW, 0) : ends[w] - firsts[at] + WINDOW]
                likely = [model.names[k] for k in np.argsort(-chances[w], kind="stable") if k != unknown][:TRIED]
                family = next((f for f in likely if confirmed(around, f)), None)
                if family is not None:
                    counts[owner[at]] += not licensed
                    found[owner[at]].add(family)
                    licensed = True
            columns = [part.column(0), pa.array(filled), pa.array(counts), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_paragraphs", "n_licence_paragraphs", "licences"])

    return slim.mapInArrow(run, "doc_id long, n_paragraphs long, n_licence_paragraphs long, licences array<string>")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("licences", F.array_join("licences", ","))
