"""Language ID: each document is a mixture of languages, found by expectation maximisation.

Character trigrams of the learning documents are counted per language into a fixed number of hash
slots. For a document, EM estimates the proportions of the languages from its trigrams; the set of
languages is the one with the best log-likelihood less a penalty per language, growing in the
order of the proportions. The model is languages x `SLOTS` numbers, whatever the corpus.

A text that is null or has no letter, and every text if nothing can be learned, is `und` with
score 0. One row per row of the input; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm import sums
from rosterlake.llm.arrays import mixed, runs
from rosterlake.llm.letters import letter_runs
from rosterlake.llm.shipping import ship

SLOTS = 1 << 16
ROUNDS = 12
#: Nats that another language must gain, per logarithm of the number of trigrams.
PENALTY = 4.0
UNKNOWN = "und"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, rows) of the trigrams around every letter."""
    points, rows = letter_runs(texts)
    middle = np.flatnonzero(points != 32)
    a, b, c = (points[middle + d].astype(np.uint64) for d in (-1, 0, 1))
    hashed = mixed((a << np.uint64(42)) | (b << np.uint64(21)) | c)
    return (hashed >> np.uint64(48)).astype(np.int64), rows[middle]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts of the languages, one array of `SLOTS` numbers each."""
    ship(docs.sparkSession)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch, _, _ in runs(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            slots, rows = trigrams(batch.column(1))
            for lang in set(langs.tolist()):
                own = slots[(langs == lang)[rows]]
                totals[lang] = totals.get(lang, 0) + np.bincount(own, minlength=SLOTS)
        for lang, counts in totals.items():
            yield from sums.packed(TaskContext.get().partitionId(), counts, lang)

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = sums.total(rows.mapInArrow(count, sums.SCHEMA), SLOTS)
    return {lang: counts for lang, counts in found.items() if counts.any()}


def _model(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    langs = sorted(counts)
    seen = np.stack([counts[lang] for lang in langs], 1).astype(float) if langs else np.zeros((SLOTS, 0))
    smooth = 0.1
    return langs, ((seen + smooth) / (seen.sum(0) + smooth * SLOTS)).astype(np.float32)


def _mixture(chance: np.ndarray, weight: np.ndarray, starts: np.ndarray, row: np.ndarray, allowed: np.ndarray):
    """Proportions and log-likelihood of every document over its allowed languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(weight, starts)[:, None]
    for _ in range(ROUNDS):
        part = chance * share[row]
        part *= (weight / part.sum(1))[:, None]
        share = np.add.reduceat(part, starts) / total
    likelihood = np.add.reduceat(weight * np.log((chance * share[row]).sum(1)), starts)
    return share, likelihood


def infer(chances: np.ndarray, slots: np.ndarray, rows: np.ndarray):
    """(documents with trigrams, proportions, chosen languages) from sorted (row, slot) trigrams."""
    keys, weight = np.unique(rows * SLOTS + slots, return_counts=True)
    row, chance, weight = keys // SLOTS, chances[keys % SLOTS], weight.astype(np.float64)
    found, starts = np.unique(row, return_index=True)
    number = np.repeat(np.arange(len(found)), np.diff(np.append(starts, len(row))))
    n_langs = chances.shape[1]
    single = np.add.reduceat(weight[:, None] * np.log(chance), starts)
    every = np.ones((len(found), n_langs))
    share, full = _mixture(chance, weight, starts, number, every)
    fee = PENALTY * np.log(np.add.reduceat(weight, starts) + 1)
    chosen = np.zeros((len(found), n_langs), bool)
    best_one = single.argmax(1)
    chosen[np.arange(len(found)), best_one] = True
    best = single.max(1) - fee
    rank = np.argsort(-share, axis=1)
    # No set of two or more can win where all languages together gain less than one fee.
    open_rows = np.flatnonzero(full - 2 * fee > best)
    for size in range(2, n_langs + 1):
        if not len(open_rows):
            break
        allowed = np.zeros((len(open_rows), n_langs))
        np.put_along_axis(allowed, rank[open_rows, :size], 1, 1)
        inside = np.isin(number, open_rows)
        own_number = np.searchsorted(open_rows, number[inside])
        own_starts = np.searchsorted(own_number, np.arange(len(open_rows)))
        own_share, likelihood = _mixture(chance[inside], weight[inside], own_starts, own_number, allowed)
        value = likelihood - size * fee[open_rows]
        better = value > best[open_rows]
        winners = open_rows[better]
        best[winners], chosen[winners] = value[better], allowed[better] > 0
        share[winners] = own_share[better]
        open_rows = winners[full[winners] - (size + 1) * fee[winners] > best[winners]]
    return found, share, chosen


def identify(docs: DataFrame, counts: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of every row; `languages` is the chosen set, by share."""
    ship(docs.sparkSession)
    langs, chances = _model(counts)
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.ArrayType(T.StringType())),
        ]
    )

    def predict(batches):
        for batch, _, _ in runs(batches):
            n = batch.num_rows
            lang, score, sets = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            slots, rows = trigrams(batch.column(1))
            if langs and len(slots):
                found, share, chosen = infer(chances, slots, rows)
                kept = np.where(chosen, share, -1.0)
                top = kept.argmax(1)
                for k, row in enumerate(found.tolist()):
                    lang[row] = langs[top[k]]
                    score[row] = min(1.0, max(0.0, float(share[k, top[k]])))
                    sets[row] = [langs[i] for i in np.argsort(-kept[k])[: chosen[k].sum()]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                names=schema.names,
            )

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(predict, schema)
