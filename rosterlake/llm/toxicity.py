"""Toxicity: one Kneser-Ney model of characters for toxic text and one for ordinary text.

Symbols are code points in lower case, white space as one blank. Runs of `ORDER` symbols are counted per class in all
labelled documents; the counts are rows of a table that grows with the labelled text. Both models
back off to the same continuation counts over both classes, so that rare expressions, seen in
neither, say nothing but how open their context is. A passage of `PASSAGE` runs is measured by the
difference of its log-likelihoods per run, and a document by its most toxic passage, since a few words
make a long text toxic. Isotonic regression over the learning documents turns that into a
chance; each of them is measured by models of the other half, as a model flatters what it has seen.

A model of at most `MODEL_RUNS` runs is sent to the tasks. A larger one stays a table: documents are
packed into blocks of bounded size with their distinct runs, which are dealt by their context to
parts, meet the model there and go back with their ratios. Both ways give the same results; the
counts of the labelled text always meet in parts. Runs are told apart by 64-bit hashes.

Without labelled rows of both classes every score is 0. A text without symbols scores as a
difference of 0. One row per row of the input; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterlake.llm.arrays import mixed, runs
from rosterlake.llm.labels import isotonic
from rosterlake.llm.letters import SPACE, classes
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

ORDER = 4
DISCOUNT = 0.75
PASSAGE = 20
BINS = 20_000
BLOCK_BYTES = 8 << 20
#: Runs of a model that is sent to the tasks, 60 bytes each.
MODEL_RUNS = 1_000_000
#: Parts in which counts of labelled runs meet, and runs of blocks for each part in which they meet the model.
PARTS = 256
PART_RUNS = 2_000_000
_COUNTS = ("toxic", "ordinary", "toxic_half", "ordinary_half")
_SYMBOLS = ("s0", "s1", "s2", "s3")
_MODELS = ("whole", "apart_0", "apart_1")
_TABLE: dict[str, np.ndarray] = {}


# --- runs of symbols ---------------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    if "symbols" not in _TABLE:
        found = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E944):
            if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
                found[c] = ord(low)
        found[classes() == SPACE] = 32
        found[0] = 32
        _TABLE["symbols"] = found
    return _TABLE["symbols"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of every run, ORDER to each; its row) of rows of bytes. A run ends at every symbol of
    a text but leading blanks; 0 stands before a text."""
    text = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
    points = np.frombuffer("".join(text).encode("utf-32-le", "replace"), np.uint32)
    rows = np.repeat(np.arange(len(text)), [len(t) for t in text])
    symbols = _symbol_table()[points]
    kept = np.ones(len(symbols), bool)
    first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
    kept[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32)
    kept[first] = symbols[first] != 32  # no blank after a blank, nor before a text
    symbols, rows = symbols[kept], rows[kept]
    columns = np.zeros((len(symbols), ORDER), np.uint32)
    for k in range(ORDER):
        back = ORDER - 1 - k
        columns[back:, k] = symbols[: len(symbols) - back] if back else symbols
        columns[back:, k][rows[back:] != rows[: len(rows) - back]] = 0
    return columns, rows


def keys_of(columns: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs; those of a context leave out the last symbol."""
    found = np.zeros(len(columns), np.uint64)
    for k in range(columns.shape[1]):
        found = mixed(found + columns[:, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return found


def _distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys ascending, symbols, number of every run)."""
    keys, first, number = np.unique(keys_of(columns), return_index=True, return_inverse=True)
    return keys, columns[first], number


def _squeeze(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _spread(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


# --- the labelled text -------------------------------------------------------------------


def _part(symbols: np.ndarray, parts: int) -> np.ndarray:
    """Where a run meets the model: by its context, so that runs of a context are together."""
    return (keys_of(symbols[:, :-1]) % np.uint64(parts)).astype(np.int64)


def counts(labelled: DataFrame, parts: int = PARTS) -> DataFrame:
    """(s0 .. s3, toxic, ordinary, toxic_half, ordinary_half) from (label, half, text): counts of the
    runs over all labelled rows, and over those of half 1. Tasks add up some text before they deal it."""

    def dealt_out(symbols, numbers):
        _, distinct, position = _distinct(np.concatenate(symbols))
        summed = [np.bincount(position, t, minlength=len(distinct)) for t in np.concatenate(numbers, axis=1)]
        summed = np.array(summed, np.uint32)
        part = _part(distinct, parts)
        for p in np.unique(part).tolist():
            mine = part == p
            packed = [_squeeze(distinct[mine].ravel()), _squeeze(summed[:, mine].ravel())]
            arrays = [pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "symbols", "counts"])

    def deal(batches):
        symbols, numbers, size = [], [], 0
        for batch, data, offsets in runs(batches):
            columns, rows = grams(data, offsets)
            _, distinct, position = _distinct(columns)
            label = batch.column(0).to_numpy(zero_copy_only=False)
            toxic, ordinary = label >= 0.5, label < 0.5  # neither without a label
            half = batch.column(1).to_numpy(zero_copy_only=False) == 1
            members = (toxic, ordinary, toxic & half, ordinary & half)
            found = np.stack([np.bincount(position[m[rows]], minlength=len(distinct)) for m in members])
            used = found.any(0)
            symbols.append(distinct[used])
            numbers.append(found[:, used])
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from dealt_out(symbols, numbers)
                symbols, numbers, size = [], [], 0
        if symbols:
            yield from dealt_out(symbols, numbers)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, numbers = np.zeros((0, ORDER), np.uint32), np.zeros((len(_COUNTS), 0))
        for batch in batches:
            rows = batch.to_pylist()
            every = np.concatenate([symbols, *(_spread(r["symbols"], np.uint32).reshape(-1, ORDER) for r in rows)])
            own = [_spread(r["counts"], np.uint32).reshape(len(_COUNTS), -1) for r in rows]
            totals = np.concatenate([numbers, *own], axis=1)
            _, symbols, position = _distinct(every)
            numbers = np.stack([np.bincount(position, t, minlength=len(symbols)) for t in totals])
        columns = [pa.array(symbols[:, k].astype(np.int32)) for k in range(ORDER)]
        columns += [pa.array(t.astype(np.int64)) for t in numbers]
        yield pa.RecordBatch.from_arrays(columns, names=[*_SYMBOLS, *_COUNTS])

    dealt = labelled.select("label", "half", "text").mapInArrow(deal, "part int, symbols binary, counts binary")
    schema = ", ".join([f"{s} int" for s in _SYMBOLS] + [f"{c} long" for c in _COUNTS])
    return dealt.groupBy("part").applyInArrow(merge, schema)


# --- the models --------------------------------------------------------------------------


def _smoothed(count: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """Absolute discounting: what is taken from the counts goes to the lower order."""
    left = F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * lower
    return F.when(total > 0, left / total).otherwise(lower)


def shared_backoff(seen: DataFrame) -> DataFrame:
    """(s1, s2, s3, backoff): Kneser-Ney probabilities of the last symbol after two others, from the
    number of different symbols before each run, for both classes together."""
    s1, s2 = (Window.partitionBy(*c) for c in (("s1", "s2"), ("s2",)))

    def level(df: DataFrame, keys: list[str], context, count: str) -> DataFrame:
        found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
        total, kinds = F.sum(count).over(context), F.count(F.lit(1)).over(context)
        return found.withColumns({f"n{count}": total, f"k{count}": kinds})

    three = level(seen.select("s1", "s2", "s3"), ["s1", "s2", "s3"], s1, "c3")
    two = level(three.select("s2", "s3"), ["s2", "s3"], s2, "c2")
    one = two.groupBy("s3").agg(F.count(F.lit(1)).alias("c1"))
    sums = one.agg(F.sum("c1").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = float(sums["n"] or 0), float(sums["k"] or 0)
    last = _smoothed(F.col("c1"), F.lit(n), F.lit(k), F.lit(1.0 / (k + 1)))
    one = one.select("s3", last.alias("p1"))
    two = two.join(one, "s3")
    two = two.select("s2", "s3", _smoothed(F.col("c2"), F.col("nc2"), F.col("kc2"), F.col("p1")).alias("p2"))
    three = three.join(two, ["s2", "s3"])
    found = _smoothed(F.col("c3"), F.col("nc3"), F.col("kc3"), F.col("p2"))
    return three.select("s1", "s2", "s3", found.alias("backoff"))


def ratios(counted: DataFrame, toxic: Column, ordinary: Column) -> DataFrame:
    """(s0 .. s3, toxic_p, ordinary_p, ratio, open): probabilities and log-likelihood ratio of every
    run seen in a class, and the ratio of runs of its context that neither class has."""
    seen = counted.select(*_SYMBOLS, toxic.alias("t"), ordinary.alias("o")).filter("t + o > 0")
    seen = materialise(seen, "toxicity-seen")
    context = Window.partitionBy("s0", "s1", "s2")
    found = seen.join(shared_backoff(seen), ["s1", "s2", "s3"])
    for c in ("t", "o"):
        total, kinds = F.sum(c).over(context), F.count_if(F.col(c) > 0).over(context)
        found = found.withColumns({f"n{c}": total, f"k{c}": kinds})
    p = [_smoothed(F.col(c), F.col(f"n{c}"), F.col(f"k{c}"), F.col("backoff")) for c in ("t", "o")]
    free = [F.when(F.col(f"n{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"n{c}")).otherwise(1.0) for c in ("t", "o")]
    return found.select(
        *_SYMBOLS, p[0].alias("toxic_p"), p[1].alias("ordinary_p"), F.log(p[0] / p[1]).alias("ratio"),
        F.log(free[0] / free[1]).alias("open"),
    )


def model(counted: DataFrame) -> DataFrame:
    """(s0 .. s3 and, for each of `_MODELS`, the ratio and its context's): the model of all labelled rows, the one
    that measures half 0, of the rows of half 1, and the reverse. NULL where a model has not seen a run."""
    half = F.col("toxic_half"), F.col("ordinary_half")
    rest = F.col("toxic") - half[0], F.col("ordinary") - half[1]
    classes_of = {"whole": (F.col("toxic"), F.col("ordinary")), "apart_0": half, "apart_1": rest}
    sums = counted.agg(*[F.sum(c).alias(f"{n}_{i}") for n, pair in classes_of.items() for i, c in enumerate(pair)])
    sums = sums.first()
    joined = None
    for name, pair in classes_of.items():
        # A half without both classes measures like the whole.
        own = pair if sums[f"{name}_0"] and sums[f"{name}_1"] else classes_of["whole"]
        found = ratios(counted, *own).select(*_SYMBOLS, F.col("ratio").alias(name), F.col("open").alias(f"{name}_open"))
        joined = found if joined is None else joined.join(found, list(_SYMBOLS), "left")
    return joined


_ANSWERS = [c for m in _MODELS for c in (m, f"{m}_open")]


class Lookup:
    """Ratios of runs by a model, or by the part of it that holds their contexts."""

    def __init__(self, symbols: np.ndarray, values: list[np.ndarray]):
        whole, context = keys_of(symbols), keys_of(symbols[:, :-1])
        order, inner = np.argsort(whole), np.argsort(context)
        self.runs, self.ratios = whole[order], [v[order] for v in values[::2]]
        self.contexts, self.opens = [], []
        for v in values[1::2]:
            known = inner[~np.isnan(v[inner])]
            keys, first = np.unique(context[known], return_index=True)
            self.contexts.append(keys)
            self.opens.append(v[known][first])

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        """models x runs: the run's ratio, that of its context, or 0 where the model has seen neither."""
        whole, context = keys_of(symbols), keys_of(symbols[:, :-1])
        found = []
        for ratios_, keys, opens in zip(self.ratios, self.contexts, self.opens):
            default = _looked_up(context, keys, opens, np.zeros(len(whole)))
            found.append(_looked_up(whole, self.runs, ratios_, default).astype(np.float32))
        return np.stack(found)


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Values of the keys among the known ones, ascending; missing keys and values stay as given."""
    if not len(known):
        return otherwise
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = (known[at] == keys) & ~np.isnan(values[at])
    return np.where(hit, values[at], otherwise)


def passages(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """The highest mean of PASSAGE runs in a row of every row, of all its runs where they are fewer; 0
    without runs."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    size = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(size) - size
    width = np.minimum(size, PASSAGE)
    at = np.arange(len(values))
    own = rows
    inside = at + width[own] <= begin[own] + size[own]
    at, own = at[inside], own[inside]
    means = (sums[at + width[own]] - sums[at]) / np.maximum(width[own], 1)
    found = np.zeros(n_rows)
    held = np.flatnonzero(size)
    if len(held):
        found[held] = np.maximum.reduceat(means, np.searchsorted(own, held))
    return found


_RATIOS = ("ratio", "ratio_0", "ratio_1")


def _by_tasks(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, ratio, ratio_0, ratio_1), with the model in every task."""
    table = learned.toPandas()  # at most MODEL_RUNS rows
    symbols = table[list(_SYMBOLS)].to_numpy(np.uint32)
    lookup = Lookup(symbols, [table[n].to_numpy(float) for n in _ANSWERS])

    def measure(batches):
        for batch, data, offsets in runs(batches):
            columns, owner = grams(data, offsets)
            _, distinct, position = _distinct(columns)
            means = [passages(a[position], owner, batch.num_rows) for a in lookup(distinct)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(m, pa.float64()) for m in means)], names=["doc_id", *_RATIOS]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in _RATIOS))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of (doc_id, text): its ids and texts, and its distinct runs."""
    binary = T.BinaryType()
    fields = {
        "block": T.LongType(), "doc_ids": T.ArrayType(rows.schema["doc_id"].dataType), "sizes": binary,
        "texts": binary, "symbols": binary, "n_runs": T.LongType(),
    }
    schema = T.StructType([T.StructField(n, k) for n, k in fields.items()])
    target = to_arrow_schema(schema)

    def close(number, ids, texts, sizes, symbols):
        _, distinct, _ = _distinct(np.concatenate(symbols))
        row_ids = pa.concat_arrays(ids)
        listed = pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids)
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = [_squeeze(np.concatenate(sizes)), packed, _squeeze(distinct.ravel())]
        arrays = [pa.array([number], pa.int64()), listed, *(pa.array([v], pa.binary()) for v in values)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([len(distinct)], pa.int64())], schema=target)

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = ([], [], [], []), 0
        for batch, data, offsets in runs(batches):
            columns, _ = grams(data, offsets)
            for part, value in zip(held, (batch.column(0), data.tobytes(), np.diff(offsets), _distinct(columns)[1])):
                part.append(value)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield close(number, *held)
                number, held, size = number + 1, ([], [], [], []), 0
        if held[0]:
            yield close(number, *held)

    return materialise(rows.mapInArrow(cut, schema), "toxicity-blocks")


def _answered(blocks: DataFrame, learned: DataFrame, parts: int) -> DataFrame:
    """(block, part, answers): the ratios of every block's runs in each of the models."""
    fields = "part int, block long, symbols binary, " + ", ".join(f"{n} double" for n in _ANSWERS)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols = _spread(row["symbols"], np.uint32).reshape(-1, ORDER)
                part = _part(symbols, parts)
                for p in np.unique(part).tolist():
                    packed = _squeeze(symbols[part == p].ravel())
                    arrays = [pa.array([p], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([packed], pa.binary())]
                    arrays += [pa.nulls(1, pa.float64()) for _ in _ANSWERS]
                    yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", "symbols", *_ANSWERS])

    def place(batches):
        for batch in batches:
            symbols = np.stack([batch.column(k).to_numpy().astype(np.uint32) for k in range(ORDER)], axis=1)
            arrays = [pa.array(_part(symbols, parts).astype(np.int32)), pa.nulls(len(symbols), pa.int64())]
            arrays.append(pa.array([s.tobytes() for s in symbols], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(batch.column(n) for n in _ANSWERS)], names=["part", "block", "symbols", *_ANSWERS]
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known, values = [], [np.zeros((0, ORDER), np.uint32)], [[np.zeros(0)] * len(_ANSWERS)]
        for batch in batches:
            mine = batch.column("block").is_valid()
            asked += batch.select(["part", "block", "symbols"]).filter(mine).to_pylist()
            rest = batch.filter(batch.column("block").is_null())
            known.append(np.frombuffer(b"".join(rest.column("symbols").to_pylist()), np.uint32).reshape(-1, ORDER))
            values.append([rest.column(n).to_numpy(zero_copy_only=False) for n in _ANSWERS])
        lookup = Lookup(np.concatenate(known), [np.concatenate(c) for c in zip(*values)])
        for row in asked:
            packed = _squeeze(lookup(_spread(row["symbols"], np.uint32).reshape(-1, ORDER)).ravel())
            arrays = [pa.array([row["block"]], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "part", "answers"])

    placed = learned.select(*_SYMBOLS, *_ANSWERS).mapInArrow(place, fields)
    both = blocks.select("block", "symbols").mapInArrow(ask, fields).union(placed)
    return both.groupBy("part").applyInArrow(answer, "block long, part int, answers binary")


def _by_blocks(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, ratio, ratio_0, ratio_1), with the model as a table."""
    blocks = _blocks(rows)
    parts = (blocks.agg(F.sum("n_runs")).first()[0] or 0) // PART_RUNS + 1
    answered = _answered(blocks, learned, parts)
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType)] + [T.StructField(n, T.DoubleType()) for n in _RATIOS]
    )
    target = to_arrow_schema(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_rows = [row for batch in batches for row in batch.to_pylist()]
        block = next(r for r in found_rows if r["doc_ids"] is not None)
        symbols = _spread(block["symbols"], np.uint32).reshape(-1, ORDER)
        part, keys = _part(symbols, parts), keys_of(symbols)
        answers = np.zeros((len(_MODELS), len(keys)), np.float32)
        for r in found_rows:
            if r["doc_ids"] is None:
                answers[:, part == r["part"]] = _spread(r["answers"], np.float32).reshape(len(_MODELS), -1)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block["texts"]), np.uint8)
        sizes = _spread(block["sizes"], np.int64)
        ends = np.cumsum(sizes)
        first, found = 0, []
        while first < len(sizes):  # some rows at a time: bounded working arrays
            low = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
            offsets = np.concatenate([[0], ends[first:last] - low])
            columns, owner = grams(data[low : ends[last - 1]], offsets)
            at = np.searchsorted(keys, keys_of(columns))
            found.append(np.stack([passages(a[at], owner, last - first) for a in answers]))
            first = last
        ids = pa.array(block["doc_ids"], target.field(0).type)
        means = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(m, pa.float64()) for m in means)], schema=target)

    stored = blocks.select("block", "doc_ids", "sizes", "texts", "symbols")
    return stored.unionByName(answered, allowMissingColumns=True).groupBy("block").applyInArrow(measure, schema)


def classify(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_runs: int = MODEL_RUNS
) -> DataFrame:
    """(doc_id, score) of every row of docs, learned from known (doc_id, label)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    # Labels grow with the documents: both sides are sorted and merged at every size.
    counted = materialise(counts(rows.join(known.hint("merge"), "doc_id")), "toxicity-counts")
    classes_seen = counted.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not classes_seen[0] or not classes_seen[1]:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    learned = materialise(model(counted), "toxicity-model")
    measured = _by_tasks(rows, learned) if learned.count() <= model_runs else _by_blocks(rows, learned)
    measured = materialise(measured, "toxicity-ratios")
    # A document of half 0 is measured by the model of half 1, and the reverse.
    apart = F.when(F.col("half") == 0, F.col("ratio_0")).otherwise(F.col("ratio_1"))
    placed = measured.join(known, "doc_id").select(F.rint(apart * BINS).alias("at"), "label")
    bins = placed.groupBy("at").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    bins = bins.sort_values("at")
    steps = bins["at"].to_numpy() / BINS
    chances = isotonic(steps, bins["y"].to_numpy(), bins["n"].to_numpy(float))

    def score(batches):
        for batch in batches:
            scores = np.interp(np.asarray(batch.column("ratio")), steps, chances)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return measured.select("doc_id", "ratio").mapInArrow(score, f"doc_id {kind}, score double")
