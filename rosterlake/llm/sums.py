"""Sums of number arrays of fixed length over tasks, without a row per element and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a slice, and tasks whose slices meet first.
SLICE = 512
FAN_IN = 32
SCHEMA = "key string, task int, slice int, numbers binary"


def _kind(whole: bool) -> str:
    return "<i8" if whole else "<f8"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "task", "slice", "numbers"])


def packed(task: int, numbers: np.ndarray, key: str = "") -> Iterator[pa.RecordBatch]:
    """Rows of `SCHEMA` for the array of one task, of whole numbers or of floats."""
    numbers = numbers.astype(_kind(np.issubdtype(numbers.dtype, np.integer)))
    cut = [numbers[a : a + SLICE] for a in range(0, len(numbers), SLICE)]
    if cut:
        yield _batch([(key, task, n, c.tobytes()) for n, c in enumerate(cut)])


def total(rows: DataFrame, length: int, whole: bool = True) -> dict[str, np.ndarray]:
    """The sum of all arrays of `length` numbers with each key.

    Slices are added in two steps, `FAN_IN` tasks at a time and then all of them, so that no task
    reads more than a part of one slice. The driver gets one array for a key. Floats are added in
    the order of the tasks.
    """
    kind = _kind(whole)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for row in batch.to_pylist():
                held[row["task"]] = np.frombuffer(row["numbers"], kind)
                key, number = row["key"], row["slice"]
        summed = sum(held[t] for t in sorted(held))
        yield _batch([(key, min(held) // FAN_IN, number, summed.tobytes())])

    first = rows.groupBy("key", F.expr(f"task div {FAN_IN}").alias("part"), "slice").applyInArrow(add, SCHEMA)
    found: dict[str, np.ndarray] = {}
    for row in first.groupBy("key", "slice").applyInArrow(add, SCHEMA).collect():
        part = np.frombuffer(bytes(row["numbers"]), kind)
        sums = found.setdefault(row["key"], np.zeros(length, kind))
        sums[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return found
