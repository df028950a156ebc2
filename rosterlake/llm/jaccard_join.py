"""N-gram Jaccard join: MinHash prefixes propose, exact set comparison decides.

Texts are sets of hashes of five consecutive words (runs of `[^\\x20\\x09-\\x0D]`, case kept); a
text of one to four words is one shingle. Texts with equal sets form one class, represented by its
least id, and only representatives are compared. Every tree has its own hashes, and texts that share
a prefix of them meet. A forest would shorten the prefixes of each text until it has met enough
others. A join has to find every pair at the threshold with the target probability, also that of a
text which has met many closer ones, so that shortening ends at the same length for all: the one that
`prefix_length` gives. Longer labels and tries that are descended step by step would find no other
pairs; only prefixes of that length are built.

Texts that met, directly or through others, are compared exactly, in tiles of bounded size: a group
of any size is cut into tiles, all pairs of tiles are compared, and each yields one count and one
link per text, never pairs.

Null and wordless texts link to nothing. Rows with a null id have no group and no links. Rows that
repeat an id belong to one document; every row of the input gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.arrays import mixed, prefix_hashes, runs, span_hashes, words
from rosterlake.llm.components import components
from rosterlake.llm.shipping import ship
from rosterlake.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
LABEL = 8
TARGET_RECALL = 0.9995
#: Texts and shingles of a tile.
TILE_TEXTS = 2048
TILE_SHINGLES = 1 << 20
_COLUMNS = 4096


def prefix_length(threshold: float, trees: int, label: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree often enough."""
    for length in range(label, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= target:
            return length
    return 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and where each row's begin."""
    starts, ends, at = words(data, offsets)
    hashes = span_hashes(prefix_hashes(data), starts, ends)
    counts = np.diff(at)
    factors = np.random.default_rng(5).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        rolled += padded[k : k + len(hashes)] * factors[k]
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row_at = np.concatenate([[0], np.cumsum(n_shingles)])
    position = np.repeat(at[:-1] - row_at[:-1], n_shingles) + np.arange(row_at[-1])
    found = rolled[position]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[at[row] : at[row + 1]]
        found[row_at[row]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(found), row_at


def signatures(docs: DataFrame, id_col: str, text_col: str, n_hashes: int) -> DataFrame:
    """(doc_id, key, n_shingles, signature) of every row; the key is equal for equal sets."""
    schema = "doc_id long, key binary, n_shingles int, signature binary"

    def sign(batches):
        rng = np.random.default_rng(8)
        factors = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
        for rows, data, offsets in runs(batches):
            hashes, at = shingles(data, offsets)
            full = np.flatnonzero(np.diff(at))
            table = np.empty((len(full), n_hashes), np.uint32)
            for k in range(n_hashes):
                if len(full):
                    least = np.minimum.reduceat(hashes * factors[k] + shifts[k], at[full])
                    table[:, k] = least >> np.uint64(32)
            keys, sizes, signed = [None] * rows.num_rows, [0] * rows.num_rows, [None] * rows.num_rows
            for n, row in enumerate(full.tolist()):
                own = np.unique(hashes[at[row] : at[row + 1]])
                keys[row] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                sizes[row], signed[row] = len(own), table[n].tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signed, pa.binary())],
                names=["doc_id", "key", "n_shingles", "signature"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, schema)


def _meetings(classes: DataFrame, trees: int, length: int) -> DataFrame:
    """Edges (a, b) between representatives that share a prefix in a tree: to the least of them."""
    size = 4 * length
    prefixes = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(t, F.substring("signature", t * size + 1, F.lit(size))),
    )
    nodes = classes.select("rep", F.explode(prefixes).alias("node"))
    shared = nodes.groupBy("node").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    shared = shared.filter("least < most").drop("most")
    return nodes.join(shared, "node").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def _compared(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold."""
    sizes = np.array([len(x) for x in a + b], np.int64)
    every = np.concatenate(a + b)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    kept = count[column] > 1
    renumbered = np.cumsum(count > 1) - 1
    rows, column = rows[kept], renumbered[column[kept]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        some = np.zeros((len(sizes), _COLUMNS), np.float32)
        some[rows[lo:hi], column[lo:hi] - first] = 1
        common += some[: len(a)] @ some[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - common
    return common >= threshold * union - 1e-6


def _least_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of the component of every node of a symmetric matrix of links."""
    label = ids.copy()
    while True:
        least = np.array([label[row].min(initial=label[n]) for n, row in enumerate(linked)])
        if (least == label).all():
            return label
        label = least


def _tiles(batches, threshold: float):
    """Rows sorted by (group, low, high, tile): counts and links of every pair of tiles."""

    def settle(rows):
        low, high = rows[0][1], rows[0][2]
        a = [r for r in rows if r[3] == low]
        b = a if low == high else [r for r in rows if r[3] == high]
        if not a or not b:
            return
        sets = [[np.frombuffer(r[6], np.uint64) for r in side] for side in (a, b)]
        hits = _compared(sets[0], sets[1], threshold)
        if low == high:
            np.fill_diagonal(hits, False)
            nodes, linked = a, hits
            links = hits @ np.array([r[5] for r in a], np.int64)
        else:
            nodes = a + b
            linked = np.zeros((len(nodes),) * 2, bool)
            linked[: len(a), len(a) :] = hits
            linked[len(a) :, : len(a)] = hits.T
            links = linked @ np.array([r[5] for r in nodes], np.int64)
        ids = np.array([r[4] for r in nodes], np.int64)
        least = _least_linked(linked, ids)
        found = links > 0
        if found.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[found], pa.int64()) for x in (ids, least, links)], names=["rep", "least", "links"]
            )

    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if len(held) > 1:
                    yield from settle(held)
                held, key = [], row[:3]
            held.append(row)
    if len(held) > 1:
        yield from settle(held)


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its group of linked texts), rep (least
    id with the same shingles) and n_links (other documents at or above the threshold)."""
    ship(docs.sparkSession)
    length = prefix_length(threshold, trees, LABEL, target_recall)
    signed = materialise(signatures(docs, id_col, text_col, trees * length), "jaccard-signatures")
    usable = signed.filter("key is not null and doc_id is not null")
    classes = usable.groupBy("key").agg(
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"),
    )
    classes = materialise(classes, "jaccard-classes")
    met = components(_meetings(classes, trees, length), "jaccard-met")

    members = met.select(F.col("node").alias("rep"), F.col("component").alias("group")).join(
        classes.select("rep", "copies", "n_shingles"), "rep"
    )
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    cut = F.greatest(F.ceil(F.col("n") / TILE_TEXTS), F.ceil(F.col("w") / TILE_SHINGLES)).cast("int")
    tiled = members.join(sizes.select("group", cut.alias("tiles")), "group").withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    )
    chosen = materialise(tiled.select("rep", "group", "copies", "tiles", "tile"), "jaccard-candidates")

    def sets(batches):
        for rows, data, offsets in runs(batches):
            hashes, at = shingles(data, offsets)
            own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(own, pa.binary())], names=[*rows.schema.names[:-1], "shingles"]
            )

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    loaded = chosen.join(texts, "rep").select("group", "tiles", "tile", "rep", "copies", "text")
    loaded = loaded.mapInArrow(
        sets, "group long, tiles int, tile int, rep long, copies long, shingles binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = loaded.select("group", "tile", "rep", "copies", "shingles", other).select(
        "group",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        "tile",
        "rep",
        "copies",
        "shingles",
    )
    keys = ["group", "low", "high"]
    compared = (
        dealt.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda batches: _tiles(batches, threshold), "rep long, least long, links long")
    )
    compared = materialise(compared, "jaccard-compared")
    grouped = components(compared.select(F.col("rep").alias("a"), F.col("least").alias("b")), "jaccard-groups")
    counted = compared.groupBy("rep").agg(F.sum("links").alias("links"))

    linked = (
        classes.select("key", "rep", "copies")
        .join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(counted, "rep", "left")
    )
    result = signed.select("doc_id", "key").join(linked, "key", "left")
    known = F.col("doc_id").isNotNull()
    return result.select(
        "doc_id",
        F.when(known, F.coalesce("component", "rep", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("rep", "doc_id")).alias("rep"),
        F.when(known & F.col("key").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        .otherwise(0)
        .cast("long")
        .alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose group has a smaller id; rows with a null id stay."""
    classes = join(docs, id_col, text_col)
    later = classes.filter("class_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(later, id_col, "left_anti")
