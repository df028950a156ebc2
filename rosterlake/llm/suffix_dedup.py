"""Suffix-array dedup: long matches of a corpus, marked by run-length compressed indexes.

A byte goes if a string of `length` bytes covers it that also starts earlier: in a text of smaller
id, or earlier in the same text. Strings are judged on the input.

1. Texts are packed into blocks. The least hash of the 32-byte grams of each window of `length`
   bytes names the window, so that equal windows have equal names, and windows of one name stand
   side by side in short contexts. A window holds the bytes before its naming gram or those behind it,
   half of `length` less the gram at least: its core. Equal windows have equal cores. Contexts meet by
   name; equal ones collapse to the first, and the others are late. Of those left, contexts go on only if
   a core of theirs stands in another one, or if they could repeat a window themselves: a phrase of 32
   bytes that occurs twice by chance, as ever more do in a larger corpus, is not sent, nor is a copy.
2. Contexts that go on meet in groups by name. In buckets by name, a group
   builds the suffix order of its contexts, keeps the Burrows-Wheeler transform as runs,
   and the matching statistic of every row (reaches `length` against an earlier start, or not) as a
   bit, for which the suffix order is read once, while it is there. All contexts are streamed
   backwards through the runs, and rows that reach the length mark their windows. The streamed
   contexts are the indexed ones, so that no row has to be located: suffix samples at run ends are
   not needed and not kept.
3. Names of very many contexts (frequent phrases) would fill one bucket. Their windows meet by the
   digest of the whole window instead, which spreads over all groups. A block sends the first of
   its equal windows only and marks the others itself, so that a passage of a third of all rows costs
   a row per block.
4. The marks return to the blocks.

A block sends one row to a group, and the number of groups is bounded: rows between blocks and groups
grow with the number of blocks, not with its square.

Null texts are empty; texts shorter than `length` keep all. Rows that repeat an id follow the order
in which they were stored; null ids follow all others. One row per row of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.arrays import RUN_BYTES, mixed, powers, prefix_hashes, ragged, runs, span_hashes
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 8 << 20
#: Contexts that a group judges by their names, bytes of contexts that a group and an index hold, on
#: average, and the number of groups from which they grow instead.
GROUP_NAMES = 1_000_000
GROUP_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
GROUPS = 2_048
#: Contexts of a name from which its windows meet by their own hashes.
FREQUENT = 2_000
#: Windows of which the least grams are sought at once, and bytes copied at once.
PIECE = 1 << 16
_LAST = np.iinfo(np.int64).max
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _zip(values: np.ndarray) -> bytes:
    return _ZIP.compress(np.ascontiguousarray(values).tobytes())


def _unzip(packed: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(_UNZIP.decompress(packed), kind)


#: Columns of the frames that travel between blocks and groups.
_NAMES = {"name": np.uint32, "left": np.uint16, "right": np.uint16, "again": np.bool_, "size": np.int32}
_NAMES |= {"id": np.int64, "whole": np.uint64}
_SPANS = {"row": np.int32, "start": np.int32, "end": np.int32}
_CONTEXTS = {"id": np.int64, "row": np.int32, "start": np.int32, "size": np.int32, "place": np.int32, "again": np.bool_}
_WINDOWS = {"id": np.int64, "row": np.int32, "start": np.int32, "high": np.uint64, "low": np.uint64}


def _pack(kinds: dict, columns: dict[str, np.ndarray], body: bytes = b"") -> bytes:
    """Columns of equal length, and bytes, as one frame."""
    n = np.int64(len(next(iter(columns.values()))))
    return _ZIP.compress(b"".join([n.tobytes(), *[columns[c].astype(kind).tobytes() for c, kind in kinds.items()], body]))


def _unpack(kinds: dict, frame: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    data, at = _UNZIP.decompress(frame), 8
    n, columns = int(np.frombuffer(data, np.int64, 1)[0]), {}
    for column, kind in kinds.items():
        columns[column] = np.frombuffer(data, kind, n, at)
        at += columns[column].nbytes
    return columns, np.frombuffer(data, np.uint8, offset=at)


def _joined(kinds: dict, parts: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of the frames of one kind, with the block of every value, and their bytes."""
    frames = [_unpack(kinds, p["frame"]) for p in parts]
    columns = {c: np.concatenate([f[c] for f, _ in frames]) for c in kinds}
    columns["block"] = np.repeat([p["block"] for p in parts], [len(next(iter(f.values()))) for f, _ in frames])
    return columns, np.concatenate([body for _, body in frames])


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Places where a new value begins, and the number of values."""
    new = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
    return np.concatenate([[0], new, [len(sorted_)]]) if len(sorted_) else np.zeros(1, np.int64)


def contexts(sums: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(names, starts, ends, places, again) of texts given by their prefix hashes: maximal runs of windows
    with one name, as spans of bytes, the first naming gram of the first window, and whether another
    window has another one. Two windows of a context are equal only if it has."""
    n, width = len(sums) - length, length - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    # Values of grams in the upper bits and places in the lower ones: the least is the first of equals.
    bits = _place_bits(length, gram)
    low = (np.uint64(1) << bits) - np.uint64(1)
    places = np.arange(PIECE + width, dtype=np.uint64)
    least = np.empty(n, np.uint64)
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        stop = b + width - 1
        values = _gram_hashes(sums, slice(a, stop), slice(a + gram, stop + gram))
        least[a:b] = _sliding(np.minimum, (values & ~low) | places[: stop - a], width)
    valid = np.ones(n, bool)
    for end in offsets[1:-1].tolist():  # windows that cross the end of a text
        valid[max(0, end - length + 1) : min(end, n)] = False
    value = least >> bits
    begin = np.ones(n, bool)
    begin[1:] = (value[1:] != value[:-1]) | ~valid[:-1]
    begin &= valid
    stop = np.flatnonzero(begin | ~valid)
    here = np.flatnonzero(begin[stop])
    starts, last = stop[here], np.append(stop, n)[here + 1] - 1
    first_place, last_place = ((least[w] & low).astype(np.int64) + w // PIECE * PIECE for w in (starts, last))
    return mixed(value[starts]), starts, last + length, first_place, first_place != last_place


def _place_bits(length: int, gram: int = GRAM) -> np.uint64:
    return np.uint64(int(PIECE + length - gram + 1).bit_length())


def _gram_hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def _cores(sums: np.ndarray, starts, ends, places, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cores of contexts: the naming gram with the bytes before it that the earlier windows
    share, and with those behind it that the later ones share; 0 without such windows. Equal windows of
    two contexts have one of the two in common, unless a context has several naming grams."""
    half = (length - gram) // 2
    earlier, later = starts <= places - half, ends - length > places - half
    left = span_hashes(sums, np.where(earlier, places - half, places), places + gram)
    right = span_hashes(sums, places, np.where(later, places + length - half + 1, places))
    one = np.uint64(1) << np.uint64(48)
    return np.where(earlier, left | one, np.uint64(0)), np.where(later, right | one, np.uint64(0))


def _shared(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether another place has the same key; places outside `of` have none."""
    result, at = np.zeros(len(keys), bool), np.flatnonzero(of)
    order = at[np.argsort(keys[at])]
    same = keys[order][1:] == keys[order][:-1]
    result[order[1:]] = same
    result[order[:-1]] |= same
    return result


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """The best of every `width` consecutive values."""
    n, span = len(values) - width + 1, 1
    while 2 * span <= width:
        values = best(values[: len(values) - span], values[span:])
        span *= 2
    return best(values[:n], values[width - span : width - span + n])


def _copied(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of spans, one after another, copied in pieces."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE))
    cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]]))
    return b"".join(ragged(data, starts[a:b], sizes[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:]))


def _contexts_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """(start in the block, prefix hashes, contexts) of runs of texts of a block, bounded in size."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = max(last, first + 1)
        sums = prefix_hashes(data[offsets[first] : offsets[last]])
        yield offsets[first], sums, contexts(sums, offsets[first : last + 1] - offsets[first], length)
        first = last


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block: ids and lengths of its rows, and their bytes."""
    kind = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, lengths binary, bytes binary"

    def close(number, ids, lengths, data):
        row_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids),
                pa.array([_zip(np.concatenate(lengths))], pa.binary()),
                pa.array([_zip(np.concatenate(data))], pa.binary()),
            ],
            names=["block", "ids", "lengths", "bytes"],
        )

    def pack(batches):
        number, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for rows, data, offsets in runs(batches):
            for part, value in zip(held, (rows.column(0), np.diff(offsets), data)):
                part.append(value)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield close(number, *held)
                number, held, size = number + 1, ([], [], []), 0
        if held[0]:
            yield close(number, *held)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(pack, schema), "suffix-blocks")


def _groups_of(names: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, order, cuts): the groups that names belong to, and where their values stand in `order`."""
    group_of = ((names >> np.uint64(7)) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group_of, kind="stable")
    cuts = _starts(group_of[order])
    return group_of[order[cuts[:-1]]], order, cuts


def _rows(block: int, groups: np.ndarray, frames: Iterator[bytes]) -> list[dict]:
    return [{"bucket": g, "block": block, "frame": f} for g, f in zip(groups.tolist(), frames)]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _repeated(blocks: DataFrame, length: int, n_groups: int, often: int) -> DataFrame:
    """(block, bucket, n_bytes, frame): for the contexts of a block in the order in which they are dealt,
    whether they go on (1), have a name so frequent that their windows do (2), or are copies (3)."""

    def name(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts, (data, offsets), ids = [], _texts(row), _ids(row)
                for base, sums, (names, starts, ends, places, again) in _contexts_of(data, offsets, length):
                    left, right = _cores(sums, starts, ends, places, length)
                    own, whole = ids[np.searchsorted(offsets, starts + base, "right") - 1], span_hashes(sums, starts, ends)
                    parts.append((names, left >> np.uint64(48), right >> np.uint64(48), again, ends - starts, own, whole))
                if not parts:
                    continue
                names, *values = (np.concatenate(x) for x in zip(*parts))
                groups, order, cuts = _groups_of(names, n_groups)
                values = dict(zip(_NAMES, (x[order] for x in (names >> np.uint64(32), *values))))
                frames = (_pack(_NAMES, {c: v[a:b] for c, v in values.items()}) for a, b in zip(cuts[:-1], cuts[1:]))
                yield _batch(_rows(row["block"], groups, frames), _DEALT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [row for batch in batches for row in batch.to_pylist()]
        all_, _ = _joined(_NAMES, parts)
        n = len(all_["name"])
        equal = np.flatnonzero(_shared(all_["whole"], np.ones(n, bool)))
        late, _ = _first_of(*(all_[c][equal] for c in ("whole", "id", "block")), equal)
        late, single = equal[late], np.ones(n, bool)
        single[late] = False
        kept, wide = np.zeros(n, bool), all_["name"].astype(np.uint64) << np.uint64(16)
        for side in ("left", "right"):
            kept |= _shared(wide | all_[side], single & (all_[side] > 0))
        _, number = np.unique(all_["name"], return_inverse=True)
        kept |= single & (np.bincount(number, all_["again"]) > 0)[number]
        busy = (np.bincount(number, kept) >= often)[number]
        flags = kept.astype(np.uint8) + (kept & busy)
        flags[late] = 3
        sizes = [len(_unpack(_NAMES, p["frame"])[0]["size"]) for p in parts]
        at = np.cumsum([0, *sizes])
        out = [
            {"block": p["block"], "bucket": p["bucket"], "n_bytes": int(all_["size"][a:b][kept[a:b]].sum()), "frame": _zip(flags[a:b])}
            for p, a, b in zip(parts, at[:-1], at[1:])
        ]
        yield _batch(out, _FLAGS)

    dealt = blocks.mapInArrow(name, "bucket long, block long, frame binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "block long, bucket long, n_bytes long, frame binary")
    return materialise(met, "suffix-names")


def _ids(row: dict) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in row["ids"]], np.int64)


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(_unzip(row["lengths"]))])
    return _unzip(row["bytes"], np.uint8), offsets


def _suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, ranks of the first symbols, how many these are: `length` at most and half of it at
    least), by doubling, or tripling where three ranks fit a key; a text ends with its least symbol.

    The rank of a suffix is the place of the first of its equals; after each round only suffixes
    that still have equals are sorted further.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    rank, open_places = np.empty(n, np.int64), np.arange(n)
    key, depth, near, known = key[order], 8, None, 8
    while True:
        suffixes = order[open_places]
        first = np.ones(len(suffixes), bool)
        first[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(first)
        rank[suffixes] = np.repeat(open_places[heads], np.diff(np.append(heads, len(first))))
        times = 3 if (n + 1) ** 3 < 1 << 63 and not 2 * depth < length < 3 * depth else 2
        if depth <= length < times * depth:
            near, known = rank.copy(), depth
        alone = first & np.append(first[1:], True)
        open_places = open_places[~alone]
        if not len(open_places):
            return (order, rank, min(depth, length)) if near is None else (order, near, known)
        suffixes = order[open_places]
        key = rank[suffixes]
        for after in range(depth, times * depth, depth):
            at = suffixes + after
            key = key * (n + 1) + np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        sorted_ = np.argsort(key)
        order[open_places], key = suffixes[sorted_], key[sorted_]
        depth *= times


class RunIndex:
    """Burrows-Wheeler runs of contexts, each followed by a 0, with samples at run ends."""

    def __init__(self, text: np.ndarray, stops: np.ndarray, length: int):
        order, rank, known = _suffix_order(text, length)
        n = len(text)
        before = text[order - 1]
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_starts = np.concatenate([[0], change])
        run_ends = np.append(change, n)
        symbols = before[self.run_starts]
        by_symbol = np.argsort(symbols, kind="stable")
        sizes = (run_ends - self.run_starts)[by_symbol]
        self.run_base = np.empty(len(symbols), np.int64)
        self.run_base[by_symbol] = np.cumsum(sizes) - sizes
        # The run of every eighth row: from there it is a few steps to the run of any row.
        self.directory = np.searchsorted(self.run_starts, np.arange(0, n, 8), "right") - 1
        self.next_starts = np.append(self.run_starts[1:], n)
        # Matching statistics, one bit: rows whose first `length` symbols also start earlier.
        far = np.concatenate([rank, np.full(length, -1, np.int64)])
        near, rest = far[order], far[order + length - known]
        head = np.ones(n, bool)
        head[1:] = (near[1:] != near[:-1]) | (rest[1:] != rest[:-1])
        heads = np.flatnonzero(head)
        first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, n)))
        self.late = np.packbits(order > first)
        inverse = np.empty(n, np.int64)
        inverse[order] = np.arange(n)
        self.ends = inverse[stops]  # the row of every context's end

    def stream(self, sizes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(contexts, offsets) of the windows that also start earlier, from the ends backwards."""
        order = np.argsort(-sizes, kind="stable")
        rows, left = self.ends[order], sizes[order]
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right").tolist()
        move = self.run_base - self.run_starts
        for step, n in enumerate(active, 1):
            rows = rows[:n]
            run = self.directory[rows >> 3]
            while (behind := self.next_starts[run] <= rows).any():
                run += behind
            rows = move[run] + rows
            if step >= length:
                hit = (self.late[rows >> 3] >> (7 - (rows & 7)) & 1).nonzero()[0]
                if len(hit):
                    yield order[hit], left[hit] - step


def _spans(context: np.ndarray, offset: np.ndarray, length: int):
    """(context, start, end) of the unions of windows at the given offsets."""
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (offset[1:] > offset[:-1] + length)
    cuts = np.append(np.flatnonzero(new), len(context))
    first, last = cuts[:-1], cuts[1:] - 1
    return context[first], offset[first], offset[last] + length


def _context_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of the naming grams and of the cores of contexts that stand one after another."""
    found, first = [], 0
    while first < len(at):
        last = max(int(np.searchsorted(at, at[first] + RUN_BYTES)), first + 1)
        a = at[first:last] - at[first]
        b, p = a + size[first:last], a + place[first:last]
        sums = prefix_hashes(data[at[first] : at[first] + b[-1]])
        names = _gram_hashes(sums, p, p + GRAM) >> _place_bits(length)
        found.append((names, *_cores(sums, a, b, p, length)))
        first = last
    return [np.concatenate(x) for x in zip(*found)]


def _mark_contexts(parts: list[dict], length: int) -> Iterator[tuple]:
    """(block, row, start, end) of the late spans of the contexts of a group."""
    all_, data = _joined(_CONTEXTS, parts)
    at = np.cumsum(all_["size"], dtype=np.int64) - all_["size"]
    order = np.lexsort((all_["start"], all_["row"], all_["block"], all_["id"]))
    hashes = [x[order] for x in _context_hashes(data, at, all_["size"], all_["place"], length)]
    at, block, row, start, size, again = (x[order] for x in (at, *(all_[c] for c in ("block", "row", "start", "size", "again"))))
    names, *cores = hashes
    # Contexts that only seemed to have a core in common, and have no window to repeat, match nothing.
    _, number = np.unique(names, return_inverse=True)
    open_ = (np.bincount(number, again) > 0)[number]
    for core in cores:
        open_ |= _shared(core, core > 0)
    own, number = np.flatnonzero(open_), number[open_]
    n_buckets = int(size[own].sum()) // BUCKET_BYTES + 1
    for bucket in range(n_buckets):
        mine = own[number % n_buckets == bucket]
        if not len(mine):
            continue
        lengths = size[mine].astype(np.int64)
        text = np.zeros(int(lengths.sum()) + len(mine), np.uint8)
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        inside = np.ones(len(text), bool)
        inside[begins + lengths] = False
        text[inside] = np.minimum(np.frombuffer(_copied(data, at[mine], lengths), np.uint8), 254) + 1
        index = RunIndex(text, begins + lengths, length)
        hits = list(index.stream(lengths, length))
        if hits:
            context, a, b = _spans(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), length)
            which = mine[context]
            yield block[which], row[which], start[which] + a, start[which] + b


def _mark_windows(parts: list[dict], length: int) -> Iterator[tuple]:
    """(block, row, start, end) of the late ones of single windows."""
    all_, _ = _joined(_WINDOWS, parts)
    block, row, start, high, low = (all_[c] for c in ("block", "row", "start", "high", "low"))
    order = np.lexsort((start, row, block, all_["id"], low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    which = order[1:][same]
    yield block[which], row[which], start[which], start[which] + length


def _hot_rows(block: int, data: np.ndarray, hot: dict[str, np.ndarray], n_groups: int, length: int) -> list[dict]:
    """The windows of the contexts of frequent names in a block: of equal contexts and of equal windows,
    the first goes to the group of its digest and the others are late."""

    def pieces(chosen):
        """(bytes, places in them) of contexts, bounded in size."""
        ends = np.cumsum(hot["size"][chosen])
        cuts = np.searchsorted(ends, np.arange(RUN_BYTES, ends[-1], RUN_BYTES))
        cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = chosen[a:b]
            body = _copied(data, hot["at"][part], hot["size"][part])
            yield part, body, np.cumsum(hot["size"][part]) - hot["size"][part]

    hashes = []
    for part, body, at in pieces(np.arange(len(hot["id"]))):
        hashes.append(span_hashes(prefix_hashes(np.frombuffer(body, np.uint8)), at, at + hot["size"][part]))
    late, first = _first_of(np.concatenate(hashes), hot["id"], hot["row"], hot["start"])
    spans = [(hot["row"][late], hot["start"][late], hot["start"][late] + hot["size"][late])]
    found, bodies, base = [], [], 0
    for part, body, at in pieces(first):
        n_windows = hot["size"][part] - length + 1
        places = ragged(np.arange(len(body)), at, n_windows)
        hashed = span_hashes(prefix_hashes(np.frombuffer(body, np.uint8)), places, places + length)
        ids, row, begin = (np.repeat(x, n_windows) for x in (hot["id"][part], hot["row"][part], hot["start"][part] - at))
        found.append((hashed, places + base, ids, row, places + begin))
        bodies.append(body)
        base += len(body)
    hashed, places, ids, row, start = (np.concatenate(x) for x in zip(*found))
    late, first = _first_of(hashed, ids, row, start)
    spans.append(_spans(row[late], start[late], length))
    rows = []
    if any(len(x) for x, _, _ in spans):
        frame = _pack(_SPANS, dict(zip(_SPANS, (np.concatenate(x) for x in zip(*spans)))))
        rows.append({"bucket": block % n_groups, "block": block, "kind": 2, "frame": frame})
    whole = b"".join(bodies)
    digests = b"".join([hashlib.blake2b(whole[p : p + length], digest_size=16).digest() for p in places[first].tolist()])
    high, low = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    groups, order, cuts = _groups_of(high, n_groups)
    values = dict(zip(_WINDOWS, (x[order] for x in (ids[first], row[first], start[first], high, low))))
    frames = (_pack(_WINDOWS, {c: v[a:b] for c, v in values.items()}) for a, b in zip(cuts[:-1], cuts[1:]))
    return rows + [r | {"kind": 1} for r in _rows(block, groups, frames)]


def _first_of(hashes: np.ndarray, ids: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all but the first of equals, places of the first ones)."""
    order = np.lexsort((start, row, ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    return order[~new], order[new]


def _to_blocks(block: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[dict]:
    order = np.argsort(block, kind="stable")
    cuts = _starts(block[order])
    values = dict(zip(_SPANS, (x[order] for x in (row, a, b))))
    return [
        {"block": int(block[order[lo]]), "frame": _pack(_SPANS, {c: v[lo:hi] for c, v in values.items()})}
        for lo, hi in zip(cuts[:-1], cuts[1:])
    ]


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, often: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal removed spans of bytes, and the
    remaining bytes."""
    ship(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    # Some 3 % of the bytes begin a context, and texts pack to a third.
    n_names = min(total * 3 // 30 // GROUP_NAMES + 1, GROUPS)
    names = _repeated(blocks, length, n_names, often)
    n_groups = min((names.agg(F.sum("n_bytes")).first()[0] or 0) // GROUP_BYTES + 1, GROUPS)

    def select(block: pa.Table, flags: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        parts = sorted(flags.to_pylist(), key=lambda p: p["bucket"])
        dealt, out = [_unzip(p["frame"], np.uint8) for p in parts], []
        if any(x.any() for x in dealt):
            (data, offsets), ids = _texts(row), _ids(row)
            found = ((n, a + base, b + base, p + base, x) for base, _, (n, a, b, p, x) in _contexts_of(data, offsets, length))
            names, start, end, place, again = (np.concatenate(x) for x in zip(*found))
            # The flags stand in the order in which the contexts were dealt to the groups that made them.
            flag = np.zeros(len(names), np.uint8)
            flag[_groups_of(names, n_names)[1]] = np.concatenate(dealt)
            text = np.searchsorted(offsets, start, "right") - 1
            size = end - start
            values = {"id": ids[text], "row": text, "start": start - offsets[text]}
            values |= {"size": size, "place": place - start, "again": again, "at": start}
            rare = np.flatnonzero(flag == 1)
            groups, order, cuts = _groups_of(names[rare], n_groups)
            order = rare[order]
            frames = (
                _pack(_CONTEXTS, {c: values[c][order[a:b]] for c in _CONTEXTS}, _copied(data, start[order[a:b]], size[order[a:b]]))
                for a, b in zip(cuts[:-1], cuts[1:])
            )
            out = [r | {"kind": 0} for r in _rows(row["block"], groups, frames)]
            late, hot = np.flatnonzero(flag == 3), np.flatnonzero(flag == 2)
            if len(late):
                spans = {"row": text[late], "start": values["start"][late], "end": values["start"][late] + size[late]}
                out.append({"bucket": row["block"] % n_groups, "block": row["block"], "kind": 2, "frame": _pack(_SPANS, spans)})
            if len(hot):
                out += _hot_rows(row["block"], data, {c: v[hot] for c, v in values.items()}, n_groups, length)
        return pa.Table.from_pylist(out, schema=_CHOSEN)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], [], []]
        for batch in batches:
            for row in batch.to_pylist():
                parts[row["kind"]].append(row)
        found = []
        if parts[0]:
            found += _mark_contexts(parts[0], length)
        if parts[1]:
            found += _mark_windows(parts[1], length)
        out = [{"block": p["block"], "frame": p["frame"]} for p in parts[2]]
        if found:
            out += _to_blocks(*(np.concatenate(x) for x in zip(*found)))
        yield _batch(out, _MARKS)

    def remove(block: pa.Table, marks: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        data, offsets = _texts(row)
        gone = np.zeros(len(data), bool)
        if marks.num_rows:
            spans, _ = _joined(_SPANS, marks.to_pylist())
            base = offsets[spans["row"]]
            edge = np.bincount(base + spans["start"], minlength=len(data) + 1)
            edge -= np.bincount(base + spans["end"], minlength=len(data) + 1)
            gone = np.cumsum(edge)[:-1] > 0
        edge = np.zeros(len(data) + 1, bool)  # where a removed span begins, or ends one byte before
        edge[1:-1] = gone[1:] != gone[:-1]
        cuts = offsets[:-1][np.diff(offsets) > 0]
        begins, stops = edge[:-1] & gone, edge[1:] & gone
        begins[cuts] = gone[cuts]
        stops[cuts[1:] - 1] = gone[cuts[1:] - 1]
        stops[-1:] = gone[-1:]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        base = offsets[np.searchsorted(offsets, begins, "right") - 1]
        fields = [pa.array(begins - base, pa.int64()), pa.array(stops - base, pa.int64())]
        spans = pa.StructArray.from_arrays(fields, ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, offsets), pa.int32()), spans)
        ends = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
        ids = block.column("ids").combine_chunks().flatten()
        columns = [ids, pa.array(np.diff(offsets), pa.int64()), spans, kept]
        return pa.table(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    by_block = blocks.groupBy("block")
    listed = names.select("block", "bucket", "n_bytes", "frame").groupBy("block")
    chosen = by_block.cogroup(listed).applyInArrow(select, "bucket long, block long, kind int, frame binary")
    marks = chosen.groupBy("bucket").applyInArrow(mark, "block long, frame binary")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    result = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(remove, result)


_MARKS = pa.schema([("block", pa.int64()), ("frame", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int64()), *_MARKS])
_FLAGS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n_bytes", pa.int64()), ("frame", pa.binary())])
_CHOSEN = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("frame", pa.binary())])
