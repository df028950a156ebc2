"""Resampling of documents towards a target corpus by importance weights of hashed n-grams.

Texts become features through Arrow kernels: `ascii_lower`, `split_pattern_regex`, `list_flatten`
and `dictionary_encode`. Shifted dictionary indices form the n-grams of a batch, each distinct one
is hashed once by CRC-32, and a document's gains are taken by index and added by segments. The
bucket counts of both corpora are number arrays of fixed length, summed over tasks; the gains go to
the second pass as one array.

The draw is without replacement: a Gumbel number, fixed by the id and the seed, is added to the
weight, and the highest scores win. The cut comes from a count by score, a whole number with a
bounded range, so that only rows at the cut or above are ordered, and those by score.

Null text has no words; a text without features has weight 0; documents below the least number of
words are never drawn; equal scores go to the smaller id (null ids last). Rows that repeat an id are
rows of their own. Without documents the result is empty; without target texts all counts of the
target are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm import sums
from rosterlake.llm.arrays import runs
from rosterlake.llm.shipping import ship
from rosterlake.operators.keys import assign_keys
from rosterlake.session import materialise

#: Fixed value: what separates words, after A-Z became a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN_BYTES = 4 << 20


@dataclass(frozen=True)
class Resampling:
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its row, words of every row) of texts without nulls."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN_WORDS)
    flat, row = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    encoded = pc.dictionary_encode(pc.filter(flat, real))
    row = pc.filter(row, real).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in encoded.dictionary.to_pylist()]
    base, found, rows = spelled, [], []
    grams, begins = codes, np.arange(len(codes))
    for size in range(1, longest + 1):
        if size > 1:  # the runs one word longer: the pair of a run and the word behind it
            begins = begins[begins + size - 1 < len(codes)]
            begins = begins[row[begins] == row[begins + size - 1]]
            pairs = grams[begins] * (len(base) + 1) + codes[begins + size - 1]
            distinct, code = np.unique(pairs, return_inverse=True)
            lead, word = np.divmod(distinct, len(base) + 1)
            spelled = [spelled[a] + b" " + base[b] for a, b in zip(lead.tolist(), word.tolist())]
            grams = np.zeros(len(codes), np.int64)
            grams[begins] = code
        hashed = np.fromiter((zlib.crc32(g) % buckets for g in spelled), np.int64, len(spelled))
        found.append(hashed[grams[begins]])
        rows.append(row[begins])
    buckets_of, row_of = np.concatenate(found), np.concatenate(rows)
    if longest > 1:
        order = np.argsort(row_of, kind="stable")
        buckets_of, row_of = buckets_of[order], row_of[order]
    return buckets_of, row_of, np.bincount(row, minlength=len(texts))


def _parts(batches: Iterator[pa.RecordBatch], rule: Resampling, limit: int = RUN_BYTES):
    for rows, data, offsets in runs(batches, limit=limit):
        # An array of its own: `ascii_lower` misreads the offsets of a slice.
        buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
        texts = pa.Array.from_buffers(pa.large_string(), rows.num_rows, buffers)
        yield rows, *features(texts, rule.longest, rule.buckets)


def bucket_counts(texts: DataFrame, rule: Resampling, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def count(batches):
        counts, some = np.zeros(rule.buckets, np.int64), False
        for _, buckets, _, _ in _parts(batches, rule):
            counts += np.bincount(buckets, minlength=rule.buckets)
            some = True
        if some:
            yield from sums.packed(TaskContext.get().partitionId(), counts)

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, sums.SCHEMA)
    return sums.total(rows, rule.buckets).get("", np.zeros(rule.buckets, np.int64))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source) of every bucket."""
    size = len(source)
    over_s, over_t = int(source.sum()) + size, int(target.sum()) + size
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * over_s / ((s + 1) * over_t))) for s, t in pairs], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, rule: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    fields = [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])

    def apply(batches):
        for rows, buckets, row, n_words in _parts(batches, rule):
            n = np.bincount(row, minlength=rows.num_rows)
            weight = np.zeros(rows.num_rows, np.int64)
            held = np.flatnonzero(n)
            if len(held):
                begins = np.cumsum(n)[held] - n[held]
                weight[held] = np.add.reduceat(gain.take(buckets), begins) // n[held]
            columns = [rows.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)


def gumbel(id_text: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def draw(weighed: DataFrame, rule: Resampling, id_col: str = "doc_id") -> DataFrame:
    """Rows with `score` and `rank`, which is null for rows not drawn."""
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col).cast("string"), rule.seed))
    scored = materialise(scored, "resample-scores")
    long_enough = F.col("n_words") >= rule.least_words
    by_score = scored.filter(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = np.array([tuple(r) for r in by_score.collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(-counts[:, 0])]
    wanted = int(counts[:, 1].sum()) * rule.percent // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", none)
    cut = int(counts[np.searchsorted(np.cumsum(counts[:, 1]), wanted), 0])
    above = long_enough & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    placed = assign_keys(scored.filter(above), order, "place")
    rank = F.when(F.col("place") <= wanted, F.col("place")).alias("rank")
    return placed.select(*scored.columns, rank).unionByName(scored.filter(~above).select("*", none))


def resample(
    docs: DataFrame,
    target: DataFrame,
    rule: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs."""
    ship(docs.sparkSession)
    source, wanted = bucket_counts(docs, rule, text_col), bucket_counts(target, rule, target_col)
    return draw(weigh(docs, gains(source, wanted), rule, id_col, text_col), rule, id_col)
