"""Benchmark decontamination: which documents hold a benchmark item, up to small edits.

Walks start at every word of the items and of the documents. A CGK random walk gives out, at each
step, the word it stands on and moves on or stays, by a random bit of that word and step, so that
texts at a small edit distance give sequences at a small Hamming distance. Repetitions sample some
steps of their walk. Sampled words are compared step by step through a trie of the items, so that
most windows leave the walk early; a walk of an item ends where its sampled words are rare enough
together, by the counts of the items' words in all documents.

Repetitions are added until the walks find `RECALL` of the copies of each item in which a share of
`EDIT_SHARE` of all bytes, at random places, is replaced, doubled or gone: items below it get more
repetitions, then more common words. Items that words do not find so often are cut into one piece of
bytes more than edits are allowed, of which one must stand unchanged. Candidates must share the
grams of bytes that the allowed edits leave, and are verified by the exact edit distance between the
item and the best part of the document around the place.

Words are runs of `[^\\x20\\x09-\\x0D]`. Items too short for any edit count only where all their
words stand in a row; items without words match nothing. Null texts are empty. The items are taken
in blocks of bounded size, each against all documents. One row per row of the input and item found;
repeated rows repeat.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.arrays import mixed, prefix_hashes, ragged, rows_of, runs, span_hashes, words
from rosterlake.llm.shipping import ship

#: Share of the copies with EDIT_SHARE of their bytes changed in which each item has to be found.
RECALL = 0.98
#: Changed copies of each item by which the recall is measured, and bytes of the items measured at once.
COPIES = 64
PART_BYTES = 256 << 10
#: Repetitions with the same bound, and bounds: chance of a document's word to meet a walk of an item.
ROUNDS = 3
CHANCES = (5e-7, 5e-6, 5e-5, 5e-4)
#: Sampled steps of a walk at most.
SAMPLES = 8
#: Edits allowed, as a share of the item's bytes.
EDIT_SHARE = 0.15
#: Bytes of items held by a task at once.
BLOCK_BYTES = 4 << 20
#: Bytes of the grams that a candidate must share with its item.
GRAMS = (5, 4)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFF)


@dataclass
class Repetition:
    """Sampled steps of one walk; the items' keys after each of them; the items (with the byte at
    which the walk began) whose walk ends with a key."""

    number: int
    steps: list[int]
    keys: list[np.ndarray] = field(default_factory=list)
    quick: list[np.ndarray] = field(default_factory=list)
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def _bits(hashes: np.ndarray, number: int) -> np.ndarray:
    return mixed(hashes + np.uint64((number + 1) * int(_FOLD) % (1 << 64)))


def _fold(key: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return mixed(key * _FOLD + symbols)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, at = words(data, offsets)
    return span_hashes(prefix_hashes(data), starts, ends), starts, at


def _quick(keys: np.ndarray) -> np.ndarray:
    return np.bincount((keys & _LOW).astype(np.int64), minlength=1 << 20) > 0


def _moved(place: np.ndarray, padded: np.ndarray, number: int, begin: int, end: int) -> np.ndarray:
    for step in range(begin, end):
        place = place + ((_bits(padded[place], number) >> np.uint64(step)).astype(np.int64) & 1)
    return place


def _among(values: np.ndarray, ordered: np.ndarray, quick: np.ndarray) -> np.ndarray:
    """Places of the values that are among the ordered ones."""
    kept = np.flatnonzero(quick[(values & _LOW).astype(np.int64)])
    if not len(kept):
        return kept
    near = np.minimum(np.searchsorted(ordered, values[kept]), len(ordered) - 1)
    return kept[ordered[near] == values[kept]]


def repetition(number: int, hashes, starts, at, offsets, share: np.ndarray, bound: float, chosen: np.ndarray) -> Repetition:
    """Walks from every word of the chosen items; each ends where the product of the shares of its
    sampled words is at most the bound."""
    rng = np.random.default_rng([2, number])
    own = Repetition(number, [0, *np.cumsum(rng.integers(2, 4, SAMPLES - 1)).tolist()])
    padded = np.concatenate([hashes, np.zeros(own.steps[-1] + 2, np.uint64)])
    item = rows_of(at)
    limit = at[1:][item]
    begin = np.flatnonzero(chosen[item])
    place, key, chance = begin.copy(), np.zeros(len(begin), np.uint64), np.ones(len(begin))
    step, before = 0, np.full(len(begin), -1)
    walks = []
    for sampled in own.steps:
        place, step = _moved(place, padded, number, step, sampled), sampled
        inside = place < limit[begin]
        begin, place, key, chance, before = (x[inside] for x in (begin, place, key, chance, before))
        key = _fold(key, padded[place])
        chance = chance * np.where(place != before, share[place], 1.0)
        before = place
        done = chance <= bound
        walks.append((begin, key, done))
        ended = begin[done]
        order = np.argsort(key[done], kind="stable")
        own.ends.append((key[done][order], item[ended][order], (starts[ended] - offsets[item[ended]])[order]))
        begin, place, key, chance, before = (x[~done] for x in (begin, place, key, chance, before))
    useful = np.zeros(0, np.int64)  # walks that end nowhere need no keys
    for begin, key, done in reversed(walks):
        useful = np.union1d(useful, begin[done])
        own.keys.insert(0, np.unique(key[np.isin(begin, useful)]))
        own.quick.insert(0, _quick(own.keys[0]))
    return own


def candidates(hashes: np.ndarray, repetitions: list[Repetition]):
    """(window, item, byte of the item that the window begins with); a window is the number of its
    first word."""
    found = [(np.zeros(0, np.int64),) * 3]
    if not repetitions:
        return found[0]
    padded = np.concatenate([hashes, np.zeros(max(r.steps[-1] for r in repetitions) + 2, np.uint64)])
    every = np.arange(len(hashes), dtype=np.int64)
    first = _fold(np.zeros(len(hashes), np.uint64), hashes)
    # No walk begins with other words than these.
    begins = np.unique(np.concatenate([r.keys[0] for r in repetitions]))
    every = every[_among(first, begins, _quick(begins))]
    first = first[every]
    number = np.searchsorted(begins, first)
    for own in repetitions:
        window, place, key, step = every, every, first, 0
        for depth, sampled in enumerate(own.steps):
            if depth:
                place, step = _moved(place, padded, own.number, step, sampled), sampled
                key = _fold(key, padded[place])
            kept = _among(key, own.keys[depth], own.quick[depth]) if depth else np.flatnonzero(np.isin(begins, own.keys[0])[number])
            window, place, key = window[kept], place[kept], key[kept]
            if not len(window):
                break
            keys, items, bytes_in = own.ends[depth]
            if not len(keys):
                continue
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            ends = ragged(np.arange(len(keys)), low, high - low)
            found.append((np.repeat(window, high - low), items[ends], bytes_in[ends]))
    return tuple(np.concatenate(x) for x in zip(*found))


def changed_copies(texts: list[bytes], share: float, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a share of their bytes, at random places, replaced, followed by another or gone.
    The places follow from the text itself, whatever other texts stand beside it."""
    parts = []
    for text in texts:
        seed = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), np.uint32)
        rng = np.random.default_rng([3, number, *seed.tolist()])
        data = np.frombuffer(text, np.uint8)
        kind = np.where(rng.random(len(data)) < share, rng.integers(1, 4, len(data)), 0)
        own = np.where(kind == 1, rng.integers(97, 123, len(data)), data)
        copy = np.repeat(own, np.where(kind == 2, 2, np.where(kind == 3, 0, 1))).astype(np.uint8)
        extra = np.cumsum(np.where(kind == 2, 2, np.where(kind == 3, 0, 1)))[kind == 2] - 1
        copy[extra] = rng.integers(97, 123, len(extra))
        parts.append(copy.tobytes())
    return _joined(parts)


def recalls(copies, n_items: int, repetitions: list[Repetition]) -> np.ndarray:
    """For each item, whether the repetitions find it in each of the copies."""
    found = np.zeros((n_items, COPIES), bool)
    for n, (hashes, at) in enumerate(copies):
        window, item, _ = candidates(hashes, repetitions)
        row = np.searchsorted(at, window, "right") - 1
        found[item[row == item], n] = True
    return found


def _bounds() -> list[float]:
    return [chance for chance in CHANCES for _ in range(ROUNDS)]


def measured(texts: list[bytes], share_of, edit_share: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many repetitions it needs, and the copies in which they find it."""
    data, offsets = _joined(texts)
    hashes, starts, at = _word_hashes(data, offsets)
    share = share_of(hashes)

    def copies():
        for n in range(COPIES):
            own, _, own_at = _word_hashes(*changed_copies(texts, edit_share, n))
            yield own, own_at

    held = list(copies()) if len(data) <= PART_BYTES else None  # those of one long text are made anew
    needed, seen = np.zeros(len(texts), np.int64), np.zeros((len(texts), COPIES), bool)
    for number, bound in enumerate(_bounds()):
        chosen = seen.sum(1) < recall * COPIES
        if not chosen.any():
            break
        needed[chosen] = number + 1
        own = repetition(number, hashes, starts, at, offsets, share, bound, chosen)
        seen |= recalls(held or copies(), len(texts), [own])
    return needed, seen


def _parts(chosen: np.ndarray, sizes: np.ndarray):
    """The chosen numbers in runs of at most `PART_BYTES` bytes, or of one."""
    first, total = 0, 0
    for n, size in enumerate(sizes[chosen].tolist()):
        if n > first and total + size > PART_BYTES:
            yield chosen[first:n]
            first, total = n, 0
        total += size
    if len(chosen):
        yield chosen[first:]


@dataclass
class Index:
    """Walks and pieces of the items that may be edited, and {words: {hash of the whole: items}} of
    those too short for it."""

    repetitions: list[Repetition]
    pieces: list[tuple[int, int, bytes]]
    short: dict[int, dict[int, list[int]]]
    recall: np.ndarray


def build(items: list[bytes], share_of, edit_share: float = EDIT_SHARE, recall: float = RECALL) -> Index:
    """The index of the items; share_of gives the share of a word, by hash, of all words.

    Copies, repetitions and bounds of an item are its own: other items and their number change none.
    """
    data, offsets = _joined(items)
    hashes, starts, at = _word_hashes(data, offsets)
    counts, share = np.diff(at), share_of(hashes)
    reach = (np.diff(offsets) * edit_share).astype(np.int64)
    edited = (counts > 0) & (reach > 0)
    needed, seen = np.zeros(len(items), np.int64), np.zeros((len(items), COPIES), bool)
    for part in _parts(np.flatnonzero(edited), np.diff(offsets)):
        needed[part], seen[part] = measured([items[n] for n in part], share_of, edit_share, recall)
    found = [
        repetition(number, hashes, starts, at, offsets, share, bound, needed > number)
        for number, bound in enumerate(_bounds()[: needed.max(initial=0)])
    ]
    pieces = []
    for n in np.flatnonzero(edited & (seen.sum(1) < recall * COPIES)).tolist():
        cuts = [len(items[n]) * k // (int(reach[n]) + 1) for k in range(int(reach[n]) + 2)]
        pieces += [(n, a, items[n][a:b]) for a, b in zip(cuts, cuts[1:])]
        seen[n] = True
    short: dict[int, dict[int, list[int]]] = {}
    for n in np.flatnonzero((counts > 0) & ~edited).tolist():
        key = np.uint64(0)
        for h in hashes[at[n] : at[n + 1]]:
            key = _fold(np.array([key]), np.array([h]))[0]
        short.setdefault(int(counts[n]), {}).setdefault(int(key), []).append(n)
    return Index(found, pieces, short, seen[edited].mean(1) if edited.any() else np.ones(0))


def _gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """A number under 8,192 for every run of `size` bytes."""
    code = np.zeros(max(len(data) - size + 1, 0), np.uint32)
    for k in range(size):
        code = code * np.uint32(0x01000193) + data[k : k + len(code)]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(19)


def piece_places(data: np.ndarray, pieces: list[tuple[int, int, bytes]]):
    """(byte, item, byte of the item) of every place where a piece stands unchanged."""
    found = [(np.zeros(0, np.int64),) * 3]
    by_size: dict[int, list] = {}
    for item, begin, piece in pieces:
        by_size.setdefault(len(piece), []).append((item, begin, piece))
    for size, own in by_size.items():
        head = min(size, GRAMS[-1])
        texts, offsets = _joined([p for _, _, p in own])
        starting = np.zeros(1 << 13, bool)
        starting[_gram_codes(texts, head)[offsets[:-1]]] = True
        keys = _keys(texts, offsets[:-1], size)
        order = np.argsort(keys, kind="stable")
        items, begins, keys = np.array([x[0] for x in own])[order], np.array([x[1] for x in own])[order], keys[order]
        place = np.flatnonzero(starting[_gram_codes(data, head)])
        place = place[place + size <= len(data)]
        here = _keys(data, place, size)
        low, high = np.searchsorted(keys, here, "left"), np.searchsorted(keys, here, "right")
        ends = ragged(np.arange(len(keys)), low, high - low)
        found.append((np.repeat(place, high - low), items[ends], begins[ends]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _keys(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes at the places."""
    key = np.zeros(len(places), np.uint64)
    for k in range(size):
        key = _fold(key, data[places + k].astype(np.uint64))
    return key


def whole_matches(hashes: np.ndarray, at: np.ndarray, short: dict[int, dict[int, list[int]]]):
    """(first word, item) of the short items, whose words all stand in a row within a row."""
    limit = np.repeat(at[1:], np.diff(at))
    for size, table in short.items():
        window = np.flatnonzero(np.arange(len(hashes)) + size <= limit)
        key = np.zeros(len(window), np.uint64)
        for k in range(size):
            key = _fold(key, hashes[window + k])
        hit = np.isin(key, np.fromiter(table, np.uint64, len(table)))
        for w, k in zip(window[hit].tolist(), key[hit].tolist()):
            for item in table[k]:
                yield w, item


def edit_distance(item: bytes, text: bytes) -> int:
    """Least edit distance between the item and any part of the text (bit-parallel, byte by byte)."""
    if item in text:
        return 0
    size = len(item)
    every, top = (1 << size) - 1, 1 << (size - 1)
    masks: dict[int, int] = {}
    for n, byte in enumerate(item):
        masks[byte] = masks.get(byte, 0) | 1 << n
    up, down, score, best = every, 0, size, size
    for byte in text:
        same = masks.get(byte, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(horizontal | up)), up & horizontal
        score += bool(more & top) - bool(less & top)
        best = min(best, score)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | (every & ~(vertical | more)), more & vertical
    return best


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edit_share: float = EDIT_SHARE,
) -> DataFrame:
    """(doc_id, item_id, distance, item_bytes, windows) for every row of docs and item it holds."""
    spark = docs.sparkSession
    ship(spark)
    kinds = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kinds[0]),
            T.StructField("item_id", kinds[1]),
            T.StructField("distance", T.IntegerType()),
            T.StructField("item_bytes", T.IntegerType()),
            T.StructField("windows", T.IntegerType()),
        ]
    )
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    queries = queries.filter("text is not null").distinct()
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // BLOCK_BYTES + 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    result = None
    for block in range(n_blocks):
        own = queries.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).collect()
        texts = [r[1].encode() for r in own]
        index = build(texts, word_shares(rows, texts), edit_share)
        found = rows.mapInArrow(_searcher([r[0] for r in own], texts, index, schema, edit_share), schema)
        result = found if result is None else result.unionByName(found)
    return result


def word_shares(rows: DataFrame, texts: list[bytes]):
    """A function from hashes of the items' words to their share of all words of the rows."""
    vocabulary = np.unique(_word_hashes(*_joined(texts))[0])
    quick = _quick(vocabulary)

    def count(batches):
        total, n_words = np.zeros(len(vocabulary), np.int64), 0
        for _, data, offsets in runs(batches):
            hashes, _, _ = _word_hashes(data, offsets)
            n_words += len(hashes)
            place = np.searchsorted(vocabulary, hashes[_among(hashes, vocabulary, quick)])
            total += np.bincount(place, minlength=len(vocabulary))
        used = np.flatnonzero(total)
        columns = [np.append(used, -1), np.append(total[used], n_words)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["word", "n"])

    n_words, counts = 0, np.zeros(len(vocabulary))
    if len(vocabulary):
        for word, n in rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
            if word < 0:
                n_words = n
            else:
                counts[word] = n
    shares = (counts + 1) / (n_words + 1)
    return lambda hashes: shares[np.searchsorted(vocabulary, hashes)]


def _searcher(names: list, texts: list[bytes], index: Index, schema: T.StructType, edit_share: float):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    held: dict[tuple[int, int], np.ndarray] = {}

    def shares_grams(codes: dict[int, np.ndarray], begin: int, end: int, item: int) -> bool:
        """Whether the bytes have as many grams of the item as its allowed edits leave."""
        for size, own in codes.items():
            if (item, size) not in held:
                held[item, size] = np.zeros(1 << 13, bool)
                held[item, size][_gram_codes(np.frombuffer(texts[item], np.uint8), size)] = True
            least = len(texts[item]) - size + 1 - size * int(len(texts[item]) * edit_share)
            if np.count_nonzero(held[item, size][own[begin : max(end - size + 1, begin)]]) < least:
                return False
        return True

    def verified(document: bytes, spots: list[int], item: bytes) -> tuple[int, int]:
        """Least distance around the given byte positions, and the number of windows within reach."""
        reach = int(len(item) * edit_share)
        best, hits, covered = len(item), 0, None
        for spot in sorted(spots):
            if covered is not None and spot <= covered:
                continue
            covered = spot + reach  # the part around this window holds the windows until there
            around = document[max(0, spot - 2 * reach - 1) : max(0, covered + len(item) + 2 * reach + 1)]
            distance = edit_distance(item, around)
            hits += distance <= reach
            best = min(best, distance)
        return best, hits

    def find(batches):
        for batch, data, offsets in runs(batches):
            hashes, starts, at = _word_hashes(data, offsets)
            codes = {size: _gram_codes(data, size) for size in GRAMS}
            window, item, begin = candidates(hashes, index.repetitions)
            pieces = piece_places(data, index.pieces)
            place = np.concatenate([starts[window], pieces[0]])
            item, begin = np.concatenate([item, pieces[1]]), np.concatenate([begin, pieces[2]])
            row = np.searchsorted(offsets, place, "right") - 1
            spots: dict[tuple[int, int], set[int]] = {}
            order = np.lexsort((place - begin, item, row))
            found = np.stack([row, item, place - begin])[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (found[:, 1:] != found[:, :-1]).any(0)
            for r, i, spot in found[:, new].T.tolist():
                reach = int(len(texts[i]) * edit_share)
                low, high = int(offsets[r]), int(offsets[r + 1])
                if shares_grams(codes, max(low, spot - reach), min(high, spot + len(texts[i]) + reach), i):
                    spots.setdefault((r, i), set()).add(spot - low)
            exact: dict[tuple[int, int], set[int]] = {}
            for window, item in whole_matches(hashes, at, index.short):
                r = int(np.searchsorted(at, window, "right")) - 1
                exact.setdefault((r, item), set()).add(int(starts[window] - offsets[r]))
            out = []
            for (row, item), where in spots.items():
                document = data[offsets[row] : offsets[row + 1]].tobytes()
                distance, hits = verified(document, list(where), texts[item])
                if hits:
                    out.append((row, names[item], distance, len(texts[item]), hits))
            out += [(row, names[item], 0, len(texts[item]), len(where)) for (row, item), where in exact.items()]
            if out:
                taken, *others = zip(*out)
                columns = [batch.column(0).take(pa.array(taken, pa.int64()))]
                columns += [pa.array(v, f.type) for v, f in zip(others, list(target)[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return find


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, all columns; rows with a null id are judged by their text."""
    key = F.to_json(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t")))
    marked = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.col(text_col).alias("text"))
    found = search(marked, items, "key", "text").select(F.col("doc_id").alias("key")).distinct()
    return marked.join(found, "key", "left_anti").select("doc.*")
