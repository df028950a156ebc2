"""Resampling, tokenizer alignment and source mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from rosterlake.llm import alignment, mixing, resample, sums
from rosterlake.llm.queries import QUERIES

from .helpers import EDGE_TEXTS, edge_documents, no_documents, sha, texts, words


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# --- resampling --------------------------------------------------------------------------


def gram_list(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return found, [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def resampled(documents, target, rule):
    """(n_features, weight, score, rank) of every (id, text)."""
    bucket = lambda g: zlib.crc32(g.encode()) % rule.buckets
    grams = [(i, *gram_list(t, rule.longest)) for i, t in documents]
    s = Counter(bucket(g) for _, _, own in grams for g in own)
    t = Counter(bucket(g) for text in target for g in gram_list(text, rule.longest)[1])
    size_s, size_t = sum(s.values()) + rule.buckets, sum(t.values()) + rule.buckets
    result, eligible = {}, []
    for i, found, own in grams:
        each = [math.floor(1000 * math.log((t[bucket(g)] + 1) * size_s / ((s[bucket(g)] + 1) * size_t))) for g in own]
        weight = sum(each) // len(each) if each else 0
        h = int(hashlib.sha256(f"{rule.seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        result[i] = [len(own), weight, score, None]
        if len(found) >= rule.least_words:
            eligible.append((-score, i))
    for rank, (_, i) in enumerate(sorted(eligible)[: rule.percent * len(eligible) // 100], 1):
        result[i][3] = rank
    return result


def test_resampling_equals_brute_force(spark, sf_dir):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    expected = resampled(texts(spark, sf_dir).items(), target, resample.Resampling())
    found = QUERIES["op11_importance_resampling"](spark, sf_dir).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in found} == expected


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_grams_equal_brute_force(spark, longest):
    rng = random.Random(longest)
    rows = [(i, " ".join(rng.choices(["a", "B", "cé", "4", "x-y", "日本"], k=rng.randrange(40)))) for i in range(300)]
    target = ["a B cé 4", "日本 a", None, ""]
    rule = resample.Resampling(longest=longest, buckets=50, least_words=5, percent=30)
    found = resample.resample(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(t,) for t in target], "text string"),
        rule,
    ).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in found} == resampled(rows, target, rule)


def test_features_of_many_runs_of_rows():
    import pyarrow as pa

    rng = random.Random(1)
    given = [None if n % 7 == 0 else " ".join(rng.choices(["aé", "Bµ", "日", "x"], k=n % 50)) for n in range(500)]
    batch = pa.record_batch({"id": pa.array(range(503)), "text": pa.array(["x", "y", "z", *given])}).slice(3)
    rule, at = resample.Resampling(longest=2, buckets=97), 0
    for rows, buckets, row, n_words in resample._parts(iter([batch]), rule, limit=100):
        for k in range(rows.num_rows):
            found, grams = gram_list(given[at], 2)
            assert n_words[k] == len(found)
            assert sorted(buckets[row == k]) == sorted(zlib.crc32(g.encode()) % 97 for g in grams)
            at += 1
    assert at == 500


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(i, "n", 25, 25, 0) for i in range(2000)]
    weighed = spark.createDataFrame(rows, "doc_id long, text string, n_words long, n_features long, weight long")
    drawn = resample.draw(weighed, resample.Resampling(percent=50)).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in drawn] == list(range(1, 1001))
    keys = [(-r.score, r.doc_id) for r in drawn]
    assert keys == sorted(keys) and len({k for k, _ in keys}) < 1000


def test_resampling_edges(spark):
    target = spark.createDataFrame([("documents long enough",)], "text string")
    found = resample.resample(edge_documents(spark), target).collect()
    assert sorted(r.n_features for r in found) == sorted(len(gram_list(t, 1)[1]) for _, t in EDGE_TEXTS)
    assert all(r.weight == 0 and r["rank"] is None for r in found if not r.n_features)
    assert resample.resample(no_documents(spark), target).count() == 0
    assert resample.resample(edge_documents(spark), target.limit(0)).count() == len(EDGE_TEXTS)


def test_sums_of_many_tasks(spark):
    import numpy as np

    def give(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from sums.packed(row["id"], np.arange(1300) * row["id"])

    rows = spark.range(200).mapInArrow(give, sums.SCHEMA)
    assert sums.total(rows, 1300)[""].tolist() == [19_900 * n for n in range(1300)]
    assert sums.total(rows.limit(0), 5) == {}

    def halves(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from sums.packed(row["id"], np.arange(3) * 0.5, "ab"[row["id"] % 2])

    found = sums.total(spark.range(100).mapInArrow(halves, sums.SCHEMA), 3, whole=False)
    assert {k: v.tolist() for k, v in found.items()} == {"a": [0, 25, 50], "b": [0, 25, 50]}


# --- alignment ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.default_vocabulary())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in letters}
    byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in letters)}
    a_bytes = lambda i: bytes(byte_of[c] for c in first.id_to_token(i))

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        """[(id, start, end)] of both sides, or none."""
        if not text:
            return [], []
        sides = []
        for ids, spell in ((first.encode(" " + text, add_special_tokens=False).ids, a_bytes), (second.encode(text), b_bytes)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at := at + len(spell(i))))
            if b"".join(map(spell, ids)) != (" " + text).encode():
                return [], []
            sides.append(side)
        return sides

    return tokens


def aligned(documents, tokens):
    """Everything token by token, with all pairs of each text."""
    linked, held = {}, Counter()
    for key, text in documents:
        a, b = tokens(text)
        links, j = [], 0
        for i, start, end in a:
            while j and b[j - 1][2] > start:
                j -= 1
            while j < len(b) and b[j][1] < end:
                if b[j][2] > start:
                    links.append((i, b[j][0]))
                j += 1
        linked[key] = links
        held.update(set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    result = {}
    for key, text in documents:
        a, b = tokens(text)
        common = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, x, y = [], 0, 0
        for end in common:
            p, q = x, y
            while x < len(a) and a[x][2] <= end:
                x += 1
            while y < len(b) and b[y][2] <= end:
                y += 1
            groups.append(",".join(str(t[0]) for t in a[p:x]) + "|" + ",".join(str(t[0]) for t in b[q:y]))
        links = linked[key]
        best = sum(held[link] == most[link[0]] for link in links)
        count = sum(held[link] for link in links)
        result[key] = (len(a), len(b), len(groups), len(links), best, count, sha(";".join(groups)) if a else "")
    return result


def test_alignment_equals_brute_force(spark, sf_dir, sides):
    expected = aligned(list(texts(spark, sf_dir).items()), sides)
    found = QUERIES["op12_tokenizer_alignment"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected


def test_alignment_of_odd_texts_in_many_blocks_and_levels(spark, sides, monkeypatch):
    rng = random.Random(5)
    parts = ["'s", " ", "  ", "\n", "\t", "a", "Re", "9", "½", "é", "é", "日本", "🙂", "!", "<|endoftext|>", "<s>", "▁", "\x00",
             "\x1c", "ab" * 40, "the ", "and ", "\r\n", " ", "ﬁ", "​", "a b"]
    rows = [(n, "".join(rng.choices(parts, k=rng.randrange(30)))) for n in range(400)]
    for name, value in {"BLOCK_BYTES": 1, "FAN_IN": 3, "FRAME": 5, "RADIX_PAIRS": 400, "REMEMBERED": 7}.items():
        monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    found = alignment.align(docs).collect()
    expected = aligned(rows, sides)
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected
    assert any(t and not expected[n][0] for n, t in rows) and any(expected[n][0] for n, _ in rows)


def test_alignment_edges(spark, sides):
    found = alignment.align(edge_documents(spark)).collect()
    expected = aligned([(n, t) for n, (_, t) in enumerate(EDGE_TEXTS)], sides)
    assert sorted(tuple(r)[1:] for r in found) == sorted(expected.values())
    assert alignment.align(no_documents(spark)).count() == 0


def test_runs_merge_to_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    runs, total = [], Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 5_000, 700)) << 20
        counts = rng.integers(1, 9, len(keys))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(alignment._run(keys, counts))
    assert list(alignment.merged(runs)) == sorted(total.items())


# --- mixing ------------------------------------------------------------------------------


def target_sizes(sizes, rule):
    """Rounds of sharing, as the contract words them, in exact numbers."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: rule.weights[n % len(rule.weights)] for n, s in enumerate(names)}
    left, open_, targets = Fraction(sum(sizes.values()) * rule.percent // 100), set(names), {}
    while open_:
        over = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / over > rule.most_epochs * sizes[s]]
        if not full:
            return targets | {s: left * weight[s] / over for s in open_}
        for s in full:
            targets[s] = Fraction(rule.most_epochs * sizes[s])
        open_ -= set(full)
        left -= sum(targets[s] for s in full)
    return targets


def check_mix(documents, rows, rule=mixing.Mix()):
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(words(text or ""))
    targets, taken = target_sizes(sizes, rule), Counter()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(targets[r.source]), abs=1e-6)
        assert 0 <= r.taken <= rule.most_epochs * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert taken[source] == math.floor(target), source
        epochs = math.floor(target / sizes[source]) if sizes[source] else 0
        mine = sorted((r for r in rows if r.source == source), key=lambda r: (r.key, r.doc_id or 0, r.size))
        extra = [(r.taken - epochs * r.size, r.size) for r in mine if r.size]
        cut = next((n for n, (x, size) in enumerate(extra) if x < size), len(extra))
        assert all(x >= 0 for x, _ in extra) and not any(x for x, _ in extra[cut + 1 :])  # a prefix of the order


def test_mix_meets_the_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(documents, mixing.mix(docs).collect())
    run = lambda: {tuple(r) for r in QUERIES["op13_source_mixing"](spark, sf_dir).collect()}
    assert run() == run()


def test_mix_with_full_sources_nulls_and_a_hot_source(spark):
    rng = random.Random(4)
    names = ["b", "a", "é", "Z", "\U0001f642", None, "z", "hot", "empty"]
    rows = [(n, " ".join(["w"] * rng.randrange(60)), rng.choice(names[:-1] + ["hot"] * 20)) for n in range(3000)]
    rows += [(9000 + n, " \n", "empty") for n in range(5)] + [(None, "a b c", "hot")] * 500 + [(7, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((5, 2, 1), (1, 50, 400), (1,)):
        rule = mixing.Mix(weights=weights)
        check_mix(rows, mixing.mix(docs, rule).collect(), rule)


def test_better_documents_come_earlier(spark):
    rows = [(n, "word " * 20 if n % 2 else "w 1 2 3 4 5 6 7 8 9 " * 2, "s" if n < 4000 else "t") for n in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, mixing.Mix(weights=(1, 3))).filter("source = 's'").collect()
    taken = Counter(r.doc_id % 2 for r in found if r.taken)
    assert taken[1] > 3 * taken[0] > 0


def test_mixing_edges(spark):
    found = mixing.mix(edge_documents(spark)).collect()
    assert sorted(r.size for r in found) == sorted(len(words(t or "")) for _, t in EDGE_TEXTS)
    assert mixing.mix(no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]
