"""License scans: a trained paragraph classifier, confirmed against the templates.

Paragraphs end at lines without words. Windows of words are the lines, the words around every line
feed inside a paragraph, and whole paragraphs of several lines, so that wrapped declarations stand
together; long lines and paragraphs are cut into overlapping windows. Sparse one- and two-word grams feed a multinomial logistic regression whose classes are the license families and
`unknown`. It learns from the templates, whole, in parts and among words of the corpus, and from a
bounded sample of corpus paragraphs (`NEGATIVES`, taken by hash) as unknown. The chance from which a
family is reported is set on all windows of the corpus that no template resembles. A prediction stands only if the
grams of some template agree with the window; its family is the one that agrees best, the likelier
one of equals, and a part of a declaration that agrees better with another family does not count.

Words are runs of letters and digits, lower case. Null and empty texts hold nothing. One row per row
of the input and family found; repeated rows repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm import sums
from rosterlake.llm.arrays import prefix_hashes, ragged, runs, span_hashes
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

UNKNOWN = "unknown"
SLOTS = 1 << 14
WINDOW, STRIDE = 32, 16
#: Words on each side of a line feed that a window around it holds.
AROUND = 8
NEGATIVES = 4000
#: Share of the corpus windows without a template that may pass the chance of a family.
FALSE_ALARMS = 0.001
#: Steps in which that chance is counted.
BINS = 10_000
#: Share of a template sentence's grams that a paragraph must hold, or the reverse.
AGREEMENT = 0.6
#: Sentences by which the families are declared.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 3.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}


def _bytes_table() -> np.ndarray:
    """Letters and digits in lower case, bytes of other letters as they are, all else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        table[b] = ord(c.lower()) if b < 128 and c.isalnum() else b if b >= 128 else 0
    return table


def windows(data: np.ndarray, offsets: np.ndarray):
    """(word hashes, first word, number of words and row of every window)."""
    folded = _bytes_table()[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = folded != 0
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    stops[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = span_hashes(prefix_hashes(folded), starts, ends)
    if not len(starts):
        return hashes, starts, starts, starts
    line, owner = np.searchsorted(np.flatnonzero(data == 10), starts), np.searchsorted(offsets, starts, "right") - 1
    apart = np.append(True, np.diff(owner) > 0)
    lines = np.flatnonzero(apart | np.append(True, np.diff(line) > 0))
    paragraphs = np.flatnonzero(apart | np.append(True, np.diff(line) > 1))  # a line without words before
    ends = np.append(paragraphs[1:], len(starts))
    several = np.searchsorted(lines, ends) - np.searchsorted(lines, paragraphs) > 1
    breaks = np.setdiff1d(lines, paragraphs, assume_unique=True)
    own = np.searchsorted(paragraphs, breaks, "right") - 1
    low, high = np.maximum(breaks - AROUND, paragraphs[own]), np.minimum(breaks + AROUND, ends[own])
    spans = [_cut(lines, np.append(lines[1:], len(starts))), _cut(paragraphs[several], ends[several]), (low, high - low)]
    first, size = (np.concatenate(x) for x in zip(*spans))
    _, once = np.unique(first * (WINDOW + 1) + size, return_index=True)
    first, size = first[once], size[once]
    return hashes, first, size, owner[first]


def _cut(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the windows of runs of words."""
    counts = ends - begins
    n_windows = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, 1)
    order = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    first = np.repeat(begins, n_windows) + order * STRIDE
    return first, np.minimum(WINDOW, np.repeat(ends, n_windows) - first)


def grams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of every word and of every pair of words."""
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    shift = np.uint64(64 - 14)
    return (hashes >> shift).astype(np.int64), ((pairs ^ (pairs >> np.uint64(29))) >> shift).astype(np.int64)


def _of(texts: list[str]):
    data = np.frombuffer("\n\n".join(texts).encode(), np.uint8)
    hashes, first, size, _ = windows(data, np.array([0, len(data)], np.int64))
    return [hashes[a : a + n] for a, n in zip(first, size)]


def _slots(words: np.ndarray) -> np.ndarray:
    one, two = grams(words)
    return np.unique(np.concatenate([one, two]))


def examples(negatives: list[np.ndarray], rounds: int = 12) -> list[tuple[int, np.ndarray]]:
    """(class, slots) for learning: templates whole, in parts and between corpus words, and negatives."""
    rng = np.random.default_rng(10)
    noise = np.concatenate(negatives) if negatives else np.zeros(1, np.uint64)
    found = [(0, _slots(words)) for words in negatives]
    for number, family in enumerate(TEMPLATES, 1):
        for words in _of(list(TEMPLATES[family])):
            found += [(number, _slots(words))] * 4
            for _ in range(rounds):
                kept = words
                if len(words) > 8:
                    size = int(rng.integers(max(6, len(words) // 2), len(words) + 1))
                    begin = int(rng.integers(0, len(words) - size + 1))
                    kept = words[begin : begin + size]
                around = [noise[int(a) : int(a) + int(n)] for a, n in zip(rng.integers(0, len(noise), 2), rng.integers(0, 12, 2))]
                found.append((number, _slots(np.concatenate([around[0], kept, around[1]]))))
    return found


def _windows_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(words): a column with the word hashes of every window, for the sample of negatives."""

    def cut(batches):
        for batch, data, offsets in runs(batches):
            hashes, first, size, _ = windows(data, offsets)
            # By hash of the content: one window in 64 leaves the task, a bounded number is used.
            keyed = prefix_hashes(hashes)
            key = span_hashes(keyed, first, first + size)
            taken = np.flatnonzero((key & np.uint64(63)) == 0)
            words = [hashes[first[k] : first[k] + size[k]].tobytes() for k in taken]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[taken].astype(np.int64), pa.int64()), pa.array(words, pa.binary())], names=["key", "words"]
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "key long, words binary")


def _distinct_sums(slots: np.ndarray, first: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of the distinct slots of every window: differences of running sums, less
    the slots that stand in the window before."""
    sums = np.zeros((len(slots) + 1, weights.shape[1]))
    np.cumsum(weights[slots], axis=0, out=sums[1:])
    found = sums[first + size] - sums[first]
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    same = np.flatnonzero(slots[order[1:]] == slots[order[:-1]])
    before = np.full(len(slots), -1)
    before[order[same + 1]] = order[same]
    again = np.flatnonzero((before >= 0) & (np.arange(len(slots)) - before < WINDOW))
    low, high = np.searchsorted(again, first), np.searchsorted(again, first + size)
    window, at = np.repeat(np.arange(len(first)), high - low), ragged(again, low, high - low)
    inside = before[at] >= first[window]
    window, at = window[inside], at[inside]
    if len(window):
        begins = np.flatnonzero(np.diff(window, prepend=-1))
        found[window[begins]] -= np.add.reduceat(weights[slots[at]], begins, axis=0)
    return found


def class_chances(
    hashes: np.ndarray, first: np.ndarray, size: np.ndarray, weights: np.ndarray, bias: np.ndarray
) -> np.ndarray:
    """windows x classes; a gram counts once in a window."""
    one, two = grams(np.append(hashes, np.uint64(0)))
    logits = _distinct_sums(one[: len(hashes)], first, size, weights) + bias
    logits += _distinct_sums(two, first, size - 1, weights)
    logits = np.exp(logits - logits.max(1, keepdims=True))
    return logits / logits.sum(1, keepdims=True)


def _template_grams() -> list[list[np.ndarray]]:
    """For every family, the pairs of words of each template sentence."""
    return [[np.unique(grams(words)[1]) if len(words) > 1 else grams(words)[0] for words in _of(list(t))] for t in TEMPLATES.values()]


def agreement(words: np.ndarray, templates: list[np.ndarray]) -> float:
    """The best share of grams in common with a template, of the template's or the paragraph's."""
    return float(agreements(words, np.zeros(1, np.int64), np.array([len(words)]), [templates])[0, 0])


def agreements(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, families: list[list[np.ndarray]]) -> np.ndarray:
    """windows x families: the best share of pairs in common with a template, of the template's or
    the window's."""
    templates = [t for family in families for t in family]
    slots, owners = np.concatenate(templates), np.repeat(np.arange(len(templates)), [len(t) for t in templates])
    order = np.argsort(slots, kind="stable")
    slots, owners = slots[order], owners[order]
    two = grams(np.append(hashes, np.uint64(0)))[1]
    keys = np.unique(np.repeat(np.arange(len(first)), size - 1) * SLOTS + ragged(two, first, size - 1))
    window, slot = keys // SLOTS, keys % SLOTS
    low, high = np.searchsorted(slots, slot, "left"), np.searchsorted(slots, slot, "right")
    met = np.repeat(window, high - low) * len(templates) + owners[ragged(np.arange(len(slots)), low, high - low)]
    common = np.bincount(met, minlength=len(first) * len(templates)).reshape(len(first), len(templates))
    n_own = np.bincount(window, minlength=len(first))[:, None]
    share = np.maximum(common / np.array([len(t) for t in templates]), np.where(n_own >= 5, common / np.maximum(n_own, 1), 0.0))
    return np.maximum.reduceat(share, np.cumsum([0, *map(len, families[:-1])]), axis=1)


def whole_ones(likely: list[tuple]) -> list[tuple]:
    """(window, agreement, chance, family) of the given ones, without those whose pairs in common all
    belong to a better agreement of another family: a window may hold only part of a declaration."""
    likely.sort(key=lambda x: x[:2])
    found = []
    for n, (begin, k, best, likeliest, family, places) in enumerate(likely):
        low, high = n, n + 1
        while low and likely[low - 1][0] > begin - WINDOW:
            low -= 1
        while high < len(likely) and likely[high][0] < begin + WINDOW:
            high += 1
        if not any(x[2] > best and x[4] != family and places <= x[5] for x in likely[low:high]):
            found.append((k, best, likeliest, family))
    return found


def chance_passed_by(counted: list[tuple[int, int]], share: float) -> float:
    """The least bound, in steps of 1 / BINS, that at most the share of the counted windows reaches."""
    total = np.zeros(BINS + 2, np.int64)
    for at, n in counted:
        total[at] += n
    above = np.cumsum(total[::-1])[::-1]
    return int(np.argmax(above <= share * above[0])) / BINS


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, family, n_windows, probability, agreement) for every row and family found in it."""
    spark = docs.sparkSession
    ship(spark)
    families = list(TEMPLATES)
    templates = _template_grams()
    sampled = materialise(_windows_of(docs, text_col).dropDuplicates(["key"]).orderBy("key").limit(negatives), "license-sample")
    plain = [np.frombuffer(r[0], np.uint64) for r in sampled.orderBy("key").select("words").collect()]
    plain = [w for w in plain if max(agreement(w, t) for t in templates) < AGREEMENT / 2]
    rows = [(float(c), Vectors.sparse(SLOTS, s.tolist(), [1.0] * len(s))) for c, s in examples(plain)]
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    fitted = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, standardization=False).fit(
        spark.createDataFrame(rows, schema)
    )
    n_classes = fitted.numClasses
    weights = fitted.coefficientMatrix.toArray().T.astype(np.float64)
    bias = fitted.interceptVector.toArray()
    paired = np.zeros(SLOTS, np.int64)
    paired[np.concatenate([t for family in templates for t in family])] = 1

    def chances(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return class_chances(hashes, first, size, weights, bias)

    def template_pairs(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pairs of words in every window that some template has too."""
        pairs = np.concatenate([[0], np.cumsum(paired[grams(np.append(hashes, np.uint64(0)))[1]])])
        return pairs[first + size - 1] - pairs[first]

    def measure(batches):
        total = np.zeros(BINS + 1, np.int64)
        for _, data, offsets in runs(batches):
            hashes, first, size, _ = windows(data, offsets)
            if not len(first):
                continue
            plain = np.ones(len(first), bool)
            # A window without a pair of a template resembles none.
            some = np.flatnonzero(template_pairs(hashes, first, size))
            plain[some] = agreements(hashes, first[some], size[some], templates).max(1, initial=0.0) < AGREEMENT / 2
            if plain.any():
                known = 1 - chances(hashes, first[plain], size[plain])[:, 0]
                total += np.bincount((known * BINS).astype(np.int64).clip(0, BINS), minlength=BINS + 1)
        yield from sums.packed(TaskContext.get().partitionId(), total)

    measured = docs.select(F.col(text_col).alias("text")).mapInArrow(measure, sums.SCHEMA)
    counted = sums.total(measured, BINS + 1).get("", np.zeros(0, np.int64))
    threshold = max(0.5, chance_passed_by(list(enumerate(counted.tolist())), FALSE_ALARMS))
    held = [set(np.concatenate(family).tolist()) for family in templates]
    least = min(int(np.ceil(AGREEMENT * min(len(t), 5))) for family in templates for t in family)
    kind = docs.schema[id_col].dataType.simpleString()
    target = f"doc_id {kind}, family string, n_windows int, probability double, agreement double"

    def find(batches):
        for batch, data, offsets in runs(batches):
            hashes, first, size, row = windows(data, offsets)
            if not len(first):
                continue
            # A window with fewer pairs of the templates agrees with none of them.
            near = np.flatnonzero(template_pairs(hashes, first, size) >= least)
            close = agreements(hashes, first[near], size[near], templates)
            agreeing = close.max(1, initial=0.0) >= AGREEMENT
            near, close = near[agreeing], close[agreeing]
            if not len(near):
                continue
            chance = chances(hashes, first[near], size[near])
            two = grams(np.append(hashes, np.uint64(0)))[1]
            likely = []
            for k in np.flatnonzero(1 - chance[:, 0] >= threshold).tolist():
                best, likeliest, family = max(zip(close[k].tolist(), chance[k, 1:].tolist(), range(len(families))))
                begin, end = int(first[near[k]]), int(first[near[k]] + size[near[k]])
                places = {j for j in range(begin, end - 1) if int(two[j]) in held[family]}
                likely.append((begin, k, best, likeliest, family, places))
            found: dict[tuple[int, int], list[float]] = {}
            for k, best, likeliest, family in whole_ones(likely):
                kept = found.setdefault((int(row[near[k]]), family), [0, 0.0, 0.0])
                kept[0] += 1
                kept[1] = max(kept[1], likeliest)
                kept[2] = max(kept[2], best)
            if found:
                keys, values = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                        pa.array([families[k[1]] for k in keys], pa.string()),
                        pa.array([int(v[0]) for v in values], pa.int32()),
                        pa.array([v[1] for v in values], pa.float64()),
                        pa.array([v[2] for v in values], pa.float64()),
                    ],
                    names=["doc_id", "family", "n_windows", "probability", "agreement"],
                )

    assert n_classes == len(families) + 1
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, target)
