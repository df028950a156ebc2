"""Quality classifier: kernel ridge regression by random Fourier features, then isotonic calibration.

Every text becomes a row of document statistics (`FEATURES`, whole text, null: empty). Random
Fourier features approximate a Gaussian kernel over the standardised statistics; partitions add up
their parts of the normal equations, whose size depends on the number of features only; the ridge
solution scores all documents. Scores of the learning rows, counted in bins, are made monotone by
isotonic regression, which turns a score into the chance of label 1.

Without any labelled row every score is 0.5. One row per row of the input; repeated rows get equal
scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import sums
from rosterlake.llm.arrays import prefix_hashes, rows_of, runs, span_hashes, words
from rosterlake.llm.labels import isotonic
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

FEATURES = (
    "log_words mean_word sd_word symbols exclamations bars punctuation upper digits other_bytes "
    "distinct_words echoes log_line dup_lines capital_words common_word"
).split()
N_FOURIER = 256
RIDGE = 1e-3
BINS = 1000
_SYMBOLS = b"#*$%&<>@^~=+_\\{}[]"


def _classes() -> dict[str, np.ndarray]:
    def marked(members) -> np.ndarray:
        table = np.zeros(256, np.float64)
        table[list(members)] = 1
        return table

    return {
        "symbols": marked(_SYMBOLS),
        "exclamations": marked(b"!"),
        "bars": marked(b"|"),
        "punctuation": marked(b".,;:?'\"()-"),
        "upper": marked(range(65, 91)),
        "digits": marked(range(48, 58)),
        "other_bytes": marked(range(128, 256)),
    }


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[at])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES."""
    starts, ends, at = words(data, offsets)
    hashes = span_hashes(prefix_hashes(data), starts, ends)
    n_rows, row = len(offsets) - 1, rows_of(at)
    n_words = np.diff(at).astype(np.float64)
    per_word = np.maximum(n_words, 1)
    sizes = (ends - starts).astype(np.float64)
    mean = _sums(sizes, at) / per_word
    out = {"log_words": np.log1p(n_words), "mean_word": mean}
    out["sd_word"] = np.sqrt(np.maximum(_sums(sizes**2, at) / per_word - mean**2, 0))
    n_bytes = np.maximum(np.diff(offsets), 1)
    for name, table in _classes().items():
        share = _sums(table[data], offsets)
        out[name] = share / (per_word if name in ("symbols", "exclamations", "bars") else n_bytes)
    order = np.lexsort((hashes, row))
    own, owner = hashes[order], row[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    out["distinct_words"] = np.bincount(owner[new], minlength=n_rows) / per_word
    first = np.flatnonzero(new)
    most = np.zeros(n_rows)
    np.maximum.at(most, owner[first], np.diff(np.append(first, len(own))))
    out["common_word"] = most / per_word
    echo = np.zeros(len(hashes))
    echo[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out["echoes"] = _sums(echo, at) / per_word
    first_byte = data[starts] if len(starts) else data[:0]
    out["capital_words"] = _sums((first_byte >= 65) & (first_byte <= 90), at) / per_word
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    a, b = cuts[:-1], cuts[1:]
    line = (b - a > 1) | (data[np.minimum(a, max(len(data) - 1, 0))] != 10 if len(data) else False)
    a, b = a[line], b[line]
    lines = span_hashes(prefix_hashes(data), a, b)
    line_row = np.searchsorted(offsets, a, "right") - 1
    n_lines = np.bincount(line_row, minlength=n_rows)
    different = np.unique(lines ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["dup_lines"] = 1 - np.bincount(line_row[different], minlength=n_rows) / np.maximum(n_lines, 1)
    out["dup_lines"][n_lines == 0] = 0
    out["log_line"] = np.log1p(np.diff(offsets) / np.maximum(n_lines, 1))
    return np.stack([out[name] for name in FEATURES], 1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def measure(batches):
        for batch, data, offsets in runs(batches):
            x = statistics(data, offsets)
            values = pa.array(x.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Model:
    """Standardisation, random features, ridge weights and the calibrated steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_fourier: int):
        rng = np.random.default_rng(7)
        width = len(mean)
        self.mean, self.scale = mean, scale
        self.turns = rng.normal(size=(width, n_fourier)) / np.sqrt(width)
        self.phase = rng.uniform(0, 2 * np.pi, n_fourier)
        self.weights = np.zeros(n_fourier + 1)
        self.steps, self.chances = np.zeros(0), np.zeros(0)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / self.turns.shape[1]) * np.cos(z @ self.turns + self.phase)
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.steps, self.chances), 0, 1)


def solved(equations: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from the sums of products, the last row and the last but one column for the constant,
    whose own product is the number of rows."""
    n = len(equations)
    penalty = ridge * equations[-1, -2] * np.eye(n) / (n - 1)
    penalty[-1, -1] = 0
    return np.linalg.solve(equations[:, :-1] + penalty + 1e-9 * np.eye(n), equations[:, -1])


def fit(learning: DataFrame, n_fourier: int = N_FOURIER, ridge: float = RIDGE) -> Model:
    """A model from (x, label), label between 0 and 1."""
    width = len(FEATURES)
    moments = learning.agg(
        F.count(F.lit(1)),
        *[F.avg(F.col("x")[k]) for k in range(width)],
        *[F.stddev_pop(F.col("x")[k]) for k in range(width)],
    ).first()
    if not moments[0]:
        return Model(np.zeros(width), np.ones(width), n_fourier)
    scale = np.array(moments[1 + width :], float)
    model = Model(np.array(moments[1 : 1 + width], float), np.where(scale > 1e-9, scale, 1.0), n_fourier)

    shape = (n_fourier + 1, n_fourier + 2)
    # By statistics, so that copies of a text are in one half.
    halves = learning.select("x", "label", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half"))

    def add_up(batches):
        totals = np.zeros((2, *shape))
        for batch in batches:
            z, y, half = model.fourier(_matrix(batch.column("x"))), np.asarray(batch.column("label")), np.asarray(batch.column("half"))
            for h in (0, 1):
                own = z[half == h]
                totals[h, :, :-1] += own.T @ own
                totals[h, :, -1] += own.T @ y[half == h]
        for h in (0, 1):
            yield from sums.packed(TaskContext.get().partitionId(), totals[h].ravel(), str(h))

    found = sums.total(halves.mapInArrow(add_up, sums.SCHEMA), shape[0] * shape[1], whole=False)
    equations = [found.get(str(h), np.zeros(shape[0] * shape[1])).reshape(shape) for h in (0, 1)]
    model.weights = solved(equations[0] + equations[1], ridge)
    # A row of one half is placed by the weights of the other: what has been fitted flatters itself.
    other = [solved(e, ridge) if e[-1, -2] else model.weights for e in (equations[1], equations[0])]

    def place(batches):
        for batch in batches:
            half, z = np.asarray(batch.column("half")), model.fourier(_matrix(batch.column("x")))
            raw = np.where(half == 0, z @ other[0], z @ other[1])
            at = np.rint(np.clip(raw, -1, 2) * BINS)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.float64()), batch.column("label")], names=["at", "label"])

    placed = halves.mapInArrow(place, "at double, label double")
    bins = placed.groupBy("at").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("at").toPandas()
    model.steps = bins["at"].to_numpy() / BINS
    model.chances = isotonic(model.steps, bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of features."""

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"]
            )

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", "x").mapInArrow(score, f"doc_id {kind}, score double")


def classify(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs, learned from known (doc_id, label)."""
    measured = materialise(features(docs, id_col, text_col), "quality-features")
    learning = materialise(measured.join(known, "doc_id").select("x", "label"), "quality-learning")
    return apply(measured, fit(learning))
