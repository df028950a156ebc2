"""Alignment of two tokenizers over a corpus, and which of their tokens belong together.

Both tokenizers encode the same bytes. Byte offsets at which tokens of both end cut a text into
groups; a link is a pair of token occurrences, one of each side, whose byte ranges overlap. The
count of a pair of ids is the number of documents that link it, corpus-wide.

The counts come from external spill counting. A block of documents reduces its pair-document
records to its distinct pairs with their numbers of documents, deals them out by the radix of the
first id, and writes each part as a sorted run of zstd frames, which is kept as a table. A
k-way heap merge adds up equal pairs of some runs at a time, until one run is left for each radix;
side-major order makes all pairs of an id neighbours, so that its highest count is known when they
end. The counted runs stream past the blocks' runs of their radix, and every block gets a count
and a mark for each of its pairs, from which its documents sum their links.

Bounds: a block holds `BLOCK_BYTES` of text or one document, a merge `FAN_IN` runs, of which one
frame each is unpacked. A frequent pair travels once per block, whatever its share of the corpus.

Null or empty text, and text that the tokens of a side do not spell exactly, has no tokens: zeros
and groups ''. Rows that repeat an id or a text are documents of their own.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterlake.llm.arrays import distinct_spans, ragged, runs
from rosterlake.llm.bpe import default_vocabulary, id_pieces, word_starts
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

BLOCK_BYTES = 12 << 20
#: Records for each radix part, and runs that are merged at once. The vocabularies bound the pairs
#: that exist, so that `PARTS` parts hold less than 400,000 of them each, however long the corpus.
RADIX_PAIRS = 1_000_000
PARTS = 4096
FAN_IN = 64
FRAME = 1 << 15
#: Distinct words that a task remembers the ids of.
REMEMBERED = 300_000
#: Fixed value: what stands for a space in the pieces of the second tokenizer.
BLANK = "▁"
_LEVEL = 3
_CACHE: dict = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# --- tokens ------------------------------------------------------------------------------


class Side:
    """Ids of words, remembered, and the bytes of ids."""

    def __init__(self, encode, pieces: list[bytes]):
        self._encode = encode
        self._forget()
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(pieces), np.uint8)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        first, number = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        listed = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self._known) > REMEMBERED:
            self._forget()
        known = self._known
        new = [w for w in listed if w not in known]
        if new:
            encoded = self._encode([w.decode("utf-8", "replace") for w in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            found = np.fromiter(chain.from_iterable(encoded), np.int64, int(sizes.sum()))
            self._pool, self._size = np.append(self._pool, found), np.append(self._size, sizes)
            self._at = np.cumsum(self._size) - self._size
        word = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))[number]
        return ragged(self._pool, self._at[word], self._size[word]), self._size[word]

    def _forget(self) -> None:
        """The remembered words by number, and the ids of all of them in a row."""
        self._known: dict[bytes, int] = {}
        self._pool, self._size, self._at = (np.zeros(0, np.int64) for _ in range(3))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.spelled, self.starts[ids], self.sizes[ids])


def _byte_side(path: str) -> Side:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True

    def encode(found):
        return [e.ids for e in tokenizer.encode_batch(found, add_special_tokens=False)]

    return Side(encode, id_pieces(path))


def _piece_side(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(BLANK in name.lstrip(BLANK) for name in names):
        raise ValueError("a piece goes on over a space: words cannot be encoded one by one")
    pieces = [
        bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(BLANK, " ").encode()
        for i, name in enumerate(names)
    ]
    one = [model.piece_to_id(BLANK)]

    def encode(found):
        # A word begins with spaces, of which the model adds the first.
        ids = model.encode([w[1:] for w in found], num_threads=1)
        return [i if len(w) > 1 else one for w, i in zip(found, ids)]

    return Side(encode, pieces)


def _sides(paths: tuple[str, str]) -> tuple[Side, Side]:
    if paths not in _CACHE:
        _CACHE[paths] = _byte_side(paths[0]), _piece_side(paths[1])
    return _CACHE[paths]


def _byte_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of the first tokenizer begin, in bytes; no word crosses rows."""
    text = data.tobytes().decode("utf-8")
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cuts = np.searchsorted(lead, offsets)
    return lead[word_starts(points, cuts, [])]


def _space_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where runs of spaces begin; every row begins with one."""
    start = data == 32
    start[1:] &= data[:-1] != 32
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are not empty, with a space in front of each, and their offsets."""
    sizes = np.diff(offsets)
    begins, sizes = offsets[:-1][sizes > 0], sizes[sizes > 0]
    moved = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.empty(int(moved[-1]), np.uint8)
    inner = np.ones(len(out), bool)
    inner[moved[:-1]] = False
    out[~inner] = 32
    out[inner] = ragged(data, begins, sizes)
    return out, moved


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _tokens(data: np.ndarray, offsets: np.ndarray, sides: tuple[Side, Side]):
    """(ids of the first side, of the second, bytes of the rows that count, rows that do not).

    Rows whose bytes a side does not give back are left out of all but the last.
    """
    begins = _byte_words(data, offsets), _space_words(data, offsets)
    ids, wrong = [], np.zeros(len(offsets) - 1, bool)
    row_of = []
    for side, starts in zip(sides, begins):
        found, size = side.ids(data, starts, np.append(starts[1:], len(data)))
        row = np.repeat(np.searchsorted(offsets, starts, "right") - 1, size)
        spelled = side.bytes_of(found)
        length = np.bincount(row, weights=side.sizes[found], minlength=len(wrong)).astype(np.int64)
        wrong |= length != np.diff(offsets)
        if wrong.any() or not np.array_equal(spelled, data):
            at = np.concatenate([[0], np.cumsum(length)])
            for r in np.flatnonzero(~wrong):
                wrong[r] = not np.array_equal(spelled[at[r] : at[r + 1]], data[offsets[r] : offsets[r + 1]])
        ids.append(found)
        row_of.append(row)
    kept = [found[~wrong[row]] for found, row in zip(ids, row_of)]
    return kept[0], kept[1], np.diff(offsets)[~wrong], wrong


def _aligned(data: np.ndarray, offsets: np.ndarray, sides: tuple[Side, Side]):
    """Of the rows of bytes: numbers of tokens of each side, groups and links, the digest of the
    groups, and (row, pair, occurrences) of every distinct link of a row."""
    n = len(offsets) - 1
    numbers = np.zeros((4, n), np.int64)
    digests = [""] * n
    real = np.flatnonzero(np.diff(offsets))
    spaced, moved = _spaced(data, offsets)
    if not _valid(spaced):  # rows that are not UTF-8 have no exact tokens
        fine = [r for r in range(len(real)) if _valid(spaced[moved[r] : moved[r + 1]])]
        real = real[fine]
        sizes = np.diff(moved)[fine]
        spaced = ragged(spaced, moved[:-1][fine], sizes)
        moved = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, np.int64)
    if not len(real):
        return numbers, digests, none, none, none
    a, b, sizes, wrong = _tokens(spaced, moved, sides)
    rows, ends = real[~wrong], np.cumsum(sizes)
    if not len(rows):
        return numbers, digests, none, none, none
    stop_a, stop_b = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
    # Sorting two ascending runs is a merge.
    stops = np.sort(np.concatenate([stop_a, stop_b]), kind="stable")
    twice = np.append(stops[1:] == stops[:-1], False)
    both, links = stops[twice], stops[~twice]  # between two links in a row, one token of each side
    of_a, of_b = np.searchsorted(stop_a, links), np.searchsorted(stop_b, links)
    cuts = [np.concatenate([[0], np.searchsorted(x, ends, "right")]) for x in (stop_a, stop_b, both, links)]
    numbers[:, rows] = [np.diff(c) for c in cuts]

    def joined(values, at, sign):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), sign)

    sided = []
    for found, stop in ((a, stop_a), (b, stop_b)):
        at = np.concatenate([[0], np.searchsorted(stop, both, "right")])
        sided.append(joined(pa.array(found).cast(pa.string()), at, ","))
    listed = joined(pc.binary_join_element_wise(*sided, "|"), cuts[2], ";")
    for row, text in zip(rows.tolist(), listed.to_pylist()):
        digests[row] = hashlib.sha256(text.encode()).hexdigest()
    pair = (a[of_a] << 32) | b[of_b]
    distinct, code = np.unique(pair, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), np.diff(cuts[3]))
    each, times = np.unique(row * len(distinct) + code, return_counts=True)
    return numbers, digests, rows[each // len(distinct)], distinct[each % len(distinct)], times


# --- runs --------------------------------------------------------------------------------


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=_LEVEL).compress(planes)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _run(keys: np.ndarray, *values: np.ndarray) -> list[bytes]:
    """A sorted run as zstd frames: steps between the keys, then each column of values."""
    frames = []
    for at in range(0, len(keys), FRAME):
        cut = slice(at, at + FRAME)
        frames.append([_pack(np.diff(keys[cut], prepend=0)), *(_pack(v[cut]) for v in values)])
    return frames


def _columns(frame: list[bytes]) -> list[np.ndarray]:
    steps, *values = map(_unpack, frame)
    return [np.cumsum(steps), *values]


def _records(run: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, documents) in order; one frame is unpacked at a time."""
    for frame in run:
        keys, counts = _columns(frame)
        yield from zip(keys.tolist(), counts.tolist())


def merged(sorted_runs: list[list[list[bytes]]]) -> Iterator[tuple[int, int]]:
    """k-way heap merge: (pair, documents of all runs), pairs ascending."""
    for pair, same in groupby(heapq.merge(*map(_records, sorted_runs)), key=lambda record: record[0]):
        yield pair, sum(n for _, n in same)


def _written(counted: Iterator[tuple[int, int]]) -> list[list[bytes]]:
    """A run from records in order, frame by frame."""
    frames, held = [], []
    for record in counted:
        held.append(record)
        if len(held) == FRAME:
            frames += _run(*np.array(held, np.int64).T)
            held = []
    return frames + (_run(*np.array(held, np.int64).T) if held else [])


def _highest(run: list[list[bytes]]) -> list[list[bytes]]:
    """The run with a mark for every pair whose count is its first id's highest.

    Side-major: an id's pairs are neighbours. Those at the edge of a frame wait for the next.
    """
    frames, keys, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for number, frame in enumerate(run, 1):
        own = _columns(frame)
        keys, counts = np.concatenate([keys, own[0]]), np.concatenate([counts, own[1]])
        ids = keys >> 32
        ready = len(keys) if number == len(run) else int(np.searchsorted(ids, ids[-1]))
        if ready:
            begins = np.flatnonzero(np.diff(ids[:ready], prepend=-1))
            most = np.maximum.reduceat(counts[:ready], begins)
            best = counts[:ready] == np.repeat(most, np.diff(np.append(begins, ready)))
            frames += _run(keys[:ready], counts[:ready], best)
            keys, counts = keys[ready:], counts[ready:]
    return frames


_RUN = "radix int, team long, block long, final boolean, frames array<array<binary>>"
_BACK = "block long, radix int, counts binary, best binary"


def _row(**values) -> pa.RecordBatch:
    kinds = {
        "radix": pa.int32(), "team": pa.int64(), "block": pa.int64(), "final": pa.bool_(),
        "frames": pa.list_(pa.list_(pa.binary())), "counts": pa.binary(), "best": pa.binary(),
    }
    columns = [pa.array([v], kinds[name]) for name, v in values.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(values))


def _radix(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, by its first id alone; ids in a row go to different parts."""
    return (keys >> 32) % parts


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, docs = np.cumsum(_unpack(row["pairs"])), _unpack(row["docs"])
                part = _radix(keys, parts)
                for radix in np.unique(part).tolist():
                    mine = part == radix
                    yield _row(
                        radix=radix, team=row["block_nr"] // FAN_IN, block=row["block"], final=False,
                        frames=_run(keys[mine], docs[mine]),
                    )

    return blocks.select("block", "block_nr", "pairs", "docs").mapInArrow(deal, _RUN)


def _merge_team(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in batch.to_pylist()]
    frames = _written(merged([row["frames"] for row in rows]))
    yield _row(radix=rows[0]["radix"], team=rows[0]["team"] // FAN_IN, block=-1, final=False, frames=frames)


def _mark_highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _row(radix=row["radix"], team=0, block=-1, final=True, frames=_highest(row["frames"]))


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and marks for the pairs of every block of a team, in the order of the block's run."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    counted = [frame for row in rows if row["final"] for frame in row["frames"]]
    spilled = [row for row in rows if not row["final"]]
    wanted = [np.concatenate([_columns(f)[0] for f in row["frames"]]) for row in spilled]
    counts = [np.zeros(len(w), np.int64) for w in wanted]
    best = [np.zeros(len(w), np.int64) for w in wanted]
    for frame in counted:
        keys, documents, highest = _columns(frame)
        for own, count, mark in zip(wanted, counts, best):
            a, b = np.searchsorted(own, keys[0]), np.searchsorted(own, keys[-1], "right")
            at = np.searchsorted(keys, own[a:b])
            count[a:b], mark[a:b] = documents[at], highest[at]
    for row, count, mark in zip(spilled, counts, best):
        yield _row(block=row["block"], radix=row["radix"], counts=_pack(count), best=_pack(mark))


# --- the corpus --------------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """One row per block: what its documents count by themselves, and its pairs."""
    long, binary = T.LongType(), T.BinaryType()
    fields = {
        "block": long, "row_ids": T.ArrayType(docs.schema[id_col].dataType), "numbers": binary,
        "digests": T.ArrayType(T.StringType()), "entries": binary, "codes": binary, "times": binary,
        "n_pairs": long, "pairs": binary, "docs": binary,
    }
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    target = to_arrow_schema(schema)

    def close(number, ids, numbers, digests, entries, keys, times):
        every = np.concatenate(keys)
        distinct, codes, docs = np.unique(every, return_inverse=True, return_counts=True)
        values = {
            "block": [number],
            "row_ids": None,
            "numbers": [_pack(np.concatenate(numbers, axis=1).ravel())],
            "digests": [[d for part in digests for d in part]],
            "entries": [_pack(np.concatenate(entries))],
            "codes": [_pack(codes)],
            "times": [_pack(np.concatenate(times))],
            "n_pairs": [len(distinct)],
            "pairs": [_pack(np.diff(distinct, prepend=0))],
            "docs": [_pack(docs)],
        }
        row_ids = pa.concat_arrays(ids)
        listed = pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids)
        columns = [listed if v is None else pa.array(v, target.field(k).type) for k, v in values.items()]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def cut(batches):
        sides = _sides(paths)
        number = TaskContext.get().partitionId() << 32
        held, size = ([], [], [], [], [], []), 0
        for rows, data, offsets in runs(batches):
            numbers, digests, row, keys, times = _aligned(data, offsets, sides)
            entries = np.bincount(row, minlength=rows.num_rows)
            for part, value in zip(held, (rows.column(0), numbers, digests, entries, keys, times)):
                part.append(value)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield close(number, *held)
                number, held, size = number + 1, ([], [], [], [], [], []), 0
        if held[0]:
            yield close(number, *held)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(cut, schema), "alignment-blocks")


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    pieces: str | None = None,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    paths = (vocabulary or default_vocabulary(), pieces or default_pieces())
    ship(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col, paths)
    # Blocks count from 0 in every task; the widest task spaces the tasks' numbers apart.
    task, nth = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    size = blocks.agg(F.max(nth), F.max(task), F.sum("n_pairs")).first()
    per_task, n_tasks, records = (size[0] or 0) + 1, (size[1] or 0) + 1, size[2] or 0
    numbered, n_blocks = blocks.withColumn("block_nr", task * per_task + nth), n_tasks * per_task
    parts = min(records // RADIX_PAIRS + 1, PARTS)
    spilled = materialise(_dealt(numbered, parts), "alignment-runs")
    merging, teams = spilled, n_blocks
    while True:  # as many levels as it takes to merge `FAN_IN` runs at a time
        merging = merging.groupBy("radix", "team").applyInArrow(_merge_team, _RUN)
        teams = -(-teams // FAN_IN)
        if teams <= 1:
            break
    counted = materialise(merging.mapInArrow(_mark_highest, _RUN), "alignment-counts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_blocks - 1) // FAN_IN).cast("long")))
    beside = counted.select("radix", copies.alias("team"), "block", "final", "frames")
    returned = spilled.unionByName(beside).groupBy("radix", "team").applyInArrow(_contribute, _BACK)

    whole = T.LongType()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, whole) for n in names)]
    schema = T.StructType([*fields, T.StructField("groups_sha256", T.StringType())])
    target = to_arrow_schema(schema)

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        row = next(r for r in rows if r["row_ids"] is not None)
        part = _radix(np.cumsum(_unpack(row["pairs"])), parts)
        counts, best = (np.zeros(row["n_pairs"], np.int64) for _ in range(2))
        for r in rows:
            if r["row_ids"] is None:
                mine = part == r["radix"]
                counts[mine], best[mine] = _unpack(r["counts"]), _unpack(r["best"])
        entries, codes, times = _unpack(row["entries"]), _unpack(row["codes"]), _unpack(row["times"])
        ends = np.cumsum(entries)

        def by_row(values):
            sums = np.concatenate([[0], np.cumsum(values * times)])
            return sums[ends] - sums[ends - entries]

        numbers = _unpack(row["numbers"]).reshape(4, -1)
        columns = [
            pa.array(row["row_ids"], target.field(0).type),
            *(pa.array(v, pa.int64()) for v in (*numbers, by_row(best[codes]), by_row(counts[codes]))),
            pa.array(row["digests"], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    stored = blocks.select("block", "row_ids", "numbers", "digests", "entries", "codes", "times", "n_pairs", "pairs")
    both = stored.unionByName(returned, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(put_back, schema)
