"""Texts of Arrow batches as flat numpy arrays, for the operators that run in Python tasks.

A batch is cut into runs of rows of bounded text size, so that working arrays stay small; one text
is always whole. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
#: Odd multiplier of the polynomial hashes, its inverse modulo 2**64, and the final mixer's.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: dict[str, np.ndarray] = {}


def runs(batches, text_col: str = "text", limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) of consecutive rows of at most `limit` bytes, or one row."""
    for batch in batches:
        texts = batch.column(text_col).cast(pa.large_binary()).fill_null(b"")
        whole = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(whole, whole[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield batch.slice(first, last - first), data[whole[first] : whole[last]], whole[first : last + 1] - whole[first]
            first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * RUN_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums: `span_hashes` turns them into hashes of spans."""
    up, _ = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end], equal for equal spans wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span for every distinct content, its number for every span), exact: spans that share a
    hash are compared symbol by symbol, and told apart by their symbols if they differ."""
    hashes = span_hashes(prefix_hashes(symbols), starts, ends)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, other = ends - starts, first[number]
    if np.array_equal(sizes, sizes[other]):
        if np.array_equal(ragged(symbols, starts, sizes), ragged(symbols, starts[other], sizes)):
            return first, number
    seen: dict[bytes, int] = {}
    spelled = [symbols[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    number = np.array([seen.setdefault(s, len(seen)) for s in spelled], np.int64)
    return np.unique(number, return_index=True)[1], number


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of every row and the total) of the runs of bytes
    outside `\\x20\\x09-\\x0D`; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    stops[cuts - 1] |= inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start+length] of all spans, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def rows_of(counts_at: np.ndarray) -> np.ndarray:
    """Row number of every element, from the offsets of the rows."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
