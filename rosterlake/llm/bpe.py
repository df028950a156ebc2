"""Byte-level BPE over a corpus: each distinct word is encoded once.

Texts are split into the tokenizer's words; a block of documents keeps its words as numbers into
its own list of distinct words. The lists meet in hash buckets, where every distinct word is
encoded once, and the ids return to the blocks and are put back by position. Decoding looks every
id up in the table of pieces. Blocks and buckets are bounded by parameters; only one text has to
fit a task.

Null text counts as empty: no ids, decoded text "". Repeated rows are encoded like any other.
Result: one row per row of the input with the id column, `ids` and `decoded`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterlake.llm.arrays import distinct_spans, list_array, prefix_hashes, ragged, runs, span_hashes
from rosterlake.llm.letters import LETTER, SPACE, classes
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

BLOCK_BYTES = 20 << 20
#: Words of a block that are put back at once.
RUN_WORDS = 200_000
BUCKET_WORDS = 400_000
#: Occurrences in a block from which a word is numbered by frequency.
FREQUENT = 3
_LEVEL = 9
_CACHE: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer(path: str):
    if ("tokenizer", path) not in _CACHE:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _CACHE["tokenizer", path] = found
    return _CACHE["tokenizer", path]


def id_pieces(path: str) -> list[bytes]:
    """The bytes of every id: pieces are written in the byte alphabet, special tokens as they are."""
    if ("pieces", path) not in _CACHE:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        # Bytes that stand for themselves; the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in stored["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in stored.get("added_tokens", [])}
        _CACHE["pieces", path] = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return _CACHE["pieces", path]


def _special(path: str) -> list[str]:
    if ("special", path) not in _CACHE:
        with open(path, encoding="utf-8") as file:
            _CACHE["special", path] = [t["content"] for t in json.load(file).get("added_tokens", [])]
    return _CACHE["special", path]


def word_starts(points: np.ndarray, cuts: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where the tokenizer's words begin, in code points.

    Words are: a contraction ('s 't 're 've 'm 'll 'd); one space at most and then a run of
    letters, of numbers or of other signs; white space, of which the last character before a word
    stands apart. `cuts` are the ends of texts, `whole` the spans of special tokens.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    limits = cuts[cuts < n]
    start[limits] = True
    last = np.zeros(n, bool)  # the last character of a text or of a run of one class
    last[:-1] = start[1:]
    last[-1] = True
    text_end = np.zeros(n, bool)
    text_end[limits[limits > 0] - 1] = True
    text_end[-1] = True
    # White space before a word: its last character begins a word, a space takes the word along.
    lead = np.flatnonzero((kinds == SPACE) & last & ~text_end)
    start[lead] = True
    start[lead[points[lead] == 32] + 1] = False
    # Contractions: a lone apostrophe that begins a word, before letters of the same text.
    marks = np.flatnonzero((points == 39) & start & last & ~text_end)
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([text_end, np.ones(3, bool)])
        one, two = padded[marks + 1], np.where(ends[marks + 1], 0, padded[marks + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for size, chosen in ((1, marks[short]), (2, marks[long & ~short])):
            start[chosen + 1] = False
            after = chosen + 1 + size
            inner = after[(after < n) & ~text_end[np.minimum(after, n) - 1]]
            start[inner[kinds[inner] == LETTER]] = True
    for a, b in whole:
        start[a] = True
        start[a + 1 : b] = False
        if b < n:
            start[b] = True
    return np.flatnonzero(start)


def _split(data: np.ndarray, offsets: np.ndarray, special: list[str]):
    """(text, its code points, starts and ends of words, number of words of every row)."""
    raw = data.tobytes()
    text = raw.decode("utf-8", "replace")
    if len(text) == len(raw):
        row_at = offsets
    else:
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row_at = lead[offsets]
        if lead[-1] != len(text):  # not UTF-8: rows one by one
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            text, row_at = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = []
    for token in special:
        at = text.find(token)
        while at >= 0:
            if np.searchsorted(row_at, at, "right") == np.searchsorted(row_at, at + len(token) - 1, "right"):
                whole.append((at, at + len(token)))
                at = text.find(token, at + len(token))
            else:
                at = text.find(token, at + 1)
    edges = np.array([e for span in whole for e in span], np.int64)
    cuts = np.unique(np.concatenate([row_at, edges])).astype(np.int64)
    starts = word_starts(points, cuts, whole)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    return text, points, starts, ends, np.diff(np.searchsorted(starts, row_at))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: most high planes are nearly empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=_LEVEL).compress(len(numbers).to_bytes(8, "little") + planes)


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(4, n).T).view("<u4").ravel()


def _pack_words(found: list[str]) -> tuple[bytes, bytes]:
    encoded = [w.encode() for w in found]
    return _pack(np.array([len(w) for w in encoded], np.uint32)), zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(encoded))


def _unpack_words(lengths: bytes, packed: bytes) -> list[bytes]:
    ends = np.cumsum(_unpack(lengths).astype(np.int64)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _blocks(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """One row per block: ids of its rows, words per row, word numbers, and its distinct words:
    frequent ones by frequency, which keeps numbers small, rare ones by spelling, which packs well."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("row_ids", T.ArrayType(kind)),
            T.StructField("row_words", T.BinaryType()),
            T.StructField("codes", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
        ]
    )

    def close(number, ids, counts, texts, inverses):
        seen: dict[str, int] = {}
        numbers = [np.array([seen.setdefault(w, len(seen)) for w in part], np.int64) for part in texts]
        codes = np.concatenate([own[inverse] for own, inverse in zip(numbers, inverses)])
        spelled = list(seen)
        frequency = np.bincount(codes, minlength=len(spelled))
        rare = np.flatnonzero(frequency < FREQUENT).tolist()
        rare.sort(key=spelled.__getitem__)
        common = np.flatnonzero(frequency >= FREQUENT)
        common = common[np.argsort(-frequency[common], kind="stable")]
        order = np.concatenate([common, np.array(rare, np.int64)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths, packed = _pack_words([spelled[i] for i in order])
        row_ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids),
                pa.array([_pack(np.concatenate(counts))], pa.binary()),
                pa.array([_pack(rank[codes])], pa.binary()),
                pa.array([len(spelled)], pa.int64()),
                pa.array([lengths], pa.binary()),
                pa.array([packed], pa.binary()),
            ],
            names=schema.names,
        )

    def cut(batches):
        special = _special(path)
        number = TaskContext.get().partitionId() << 32
        held, size = ([], [], [], []), 0
        for rows, data, offsets in runs(batches):
            text, points, starts, ends, counts = _split(data, offsets, special)
            first, inverse = distinct_spans(points, starts, ends)
            found = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            for part, value in zip(held, (rows.column(0), counts, found, inverse.astype(np.int32))):
                part.append(value)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield close(number, *held)
                number, held, size = number + 1, ([], [], [], []), 0
        if held[0]:
            yield close(number, *held)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(cut, schema), "bpe-blocks")


def _dictionary(blocks: DataFrame, n_buckets: int, path: str) -> DataFrame:
    """(block, codes, n_ids, ids): the ids of the words of every block, from one encoding each."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                listed = _unpack_words(row["lengths"], row["words"])
                ends = np.cumsum([0, *map(len, listed)])
                sums = prefix_hashes(np.frombuffer(b"".join(listed), np.uint8))
                bucket_of = span_hashes(sums, ends[:-1], ends[1:]) % np.uint64(n_buckets)
                order = np.argsort(bucket_of, kind="stable")
                buckets, first = np.unique(bucket_of[order], return_index=True)
                for bucket, a, b in zip(buckets.tolist(), first, np.append(first[1:], len(order))):
                    codes = order[a:b]
                    own = [listed[i] for i in codes]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([bucket], pa.int64()),
                            pa.array([row["block"]], pa.int64()),
                            pa.array([_pack(np.diff(codes, prepend=0))], pa.binary()),
                            pa.array([_pack(np.array([len(w) for w in own]))], pa.binary()),
                            pa.array([zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(own))], pa.binary()),
                        ],
                        names=["bucket", "block", "codes", "lengths", "words"],
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                listed = _unpack_words(row["lengths"], row["words"])
                new = [w for w in listed if w not in known]
                for a in range(0, len(new), 10_000):
                    some = new[a : a + 10_000]
                    encoded = tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)
                    known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(some, encoded))
                ids = [known[w] for w in listed]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([row["codes"]], pa.binary()),
                        pa.array([_pack(np.array([len(i) // 4 for i in ids]))], pa.binary()),
                        pa.array([_pack(np.frombuffer(b"".join(ids), np.uint32))], pa.binary()),
                    ],
                    names=["block", "codes", "n_ids", "ids"],
                )

    dealt = blocks.select("block", "lengths", "words").mapInArrow(
        deal, "bucket long, block long, codes binary, lengths binary, words binary"
    )
    return dealt.groupBy("bucket").applyInArrow(encode, "block long, codes binary, n_ids binary, ids binary")


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Every row of docs as (id, ids, decoded)."""
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col, path)
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    returned = _dictionary(blocks, n_words // BUCKET_WORDS + 1, path)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )

    target = to_arrow_schema(schema)

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        row = next(r for r in rows if r["row_ids"] is not None)
        parts = [r for r in rows if r["row_ids"] is None]
        row_ids = pa.array(row["row_ids"], target.field(0).type)
        size, at = (np.zeros(row["n_words"], np.int64) for _ in range(2))
        pools, base = [], 0
        for part in parts:
            mine = np.cumsum(_unpack(part["codes"]).astype(np.int64))
            n_ids = _unpack(part["n_ids"]).astype(np.int64)
            size[mine] = n_ids
            at[mine] = base + np.cumsum(n_ids) - n_ids
            pools.append(_unpack(part["ids"]).astype(np.int32))
            base += len(pools[-1])
        pool = np.concatenate(pools) if pools else np.zeros(0, np.int32)
        pieces = id_pieces(path)
        spelled = [
            b"".join([pieces[i] for i in pool[a:b].tolist()]) for a, b in zip(at.tolist(), (at + size).tolist())
        ]
        codes = _unpack(row["codes"])
        limits = np.concatenate([[0], np.cumsum(_unpack(row["row_words"]).astype(np.int64))])
        first = 0
        while first < len(row_ids):  # some rows at a time: bounded working arrays
            last = max(first + 1, int(np.searchsorted(limits, limits[first] + RUN_WORDS, "right")) - 1)
            last = min(last, len(row_ids))
            own = codes[limits[first] : limits[last]]
            ids = ragged(pool, at[own], size[own])
            ends = np.concatenate([[0], np.cumsum(size[own])])[limits[first : last + 1] - limits[first]]
            listed, cuts = own.tolist(), (limits[first : last + 1] - limits[first]).tolist()
            decoded = [
                b"".join([spelled[c] for c in listed[a:b]]).decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])
            ]
            columns = [row_ids[first:last], list_array(ids, ends, pa.int32()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            first = last

    # Both sides of the join by block as one list of rows, so that the result leaves piece by piece.
    stored = blocks.select("block", "row_ids", "row_words", "codes", "n_words")
    both = stored.unionByName(returned, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(put_back, schema)


def decode(encoded: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, decoded) for any rows with lists of ids; rows that repeat an id must be equal.

    A join of the ids with the table of pieces, whose size the vocabulary bounds. Null lists and
    lists without ids give "".
    """
    spark, path = encoded.sparkSession, vocabulary or default_vocabulary()
    pieces = spark.createDataFrame(list(enumerate(id_pieces(path))), "token int, piece binary")
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).distinct()
    each = rows.select("id", F.posexplode("ids").alias("pos", "token")).join(F.broadcast(pieces), "token")
    joined = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.col("p")["h"], "")), "UTF-8")
    found = rows.select("id").join(joined.select(F.col("id").alias("i"), text.alias("t")), F.col("id").eqNullSafe(F.col("i")), "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("t", F.lit("")).alias("decoded"))
