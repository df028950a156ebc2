"""Trained operators: held-out accuracy, parts against plain versions, and edges."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rosterlake.llm import language_id, licenses, quality_model, toxicity
from rosterlake.llm.labels import isotonic
from rosterlake.llm.queries import QUERIES
from rosterlake.llm.shipping import ship

from .helpers import EDGE_TEXTS, edge_documents, no_documents, texts


@pytest.fixture(scope="module")
def larger(sf_dir):
    """Classifiers need more labelled rows than the smallest tables have."""
    return sf_dir.replace("sf0.001", "sf0.01")


def known(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label double")


# --- language ----------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, larger):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, larger).collect()
    held_out = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(held_out) > len(rows) / 4
    assert sum(r.lang_pred == langs[r.doc_id] for r in held_out) >= 0.99 * len(held_out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_mixture_keeps_both_languages(spark):
    ship(spark)
    english, german = "the house that was of the ", "die schule nicht auch ein "
    learned = [(n, t * 20, lang) for n, (t, lang) in enumerate([(english, "en"), (german, "de")] * 3)]
    counts = language_id.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    mixed = [(1, english * 30), (2, german * 30), (3, english * 30 + german * 10), (4, "1 2 3 !"), (5, None)]
    rows = language_id.identify(spark.createDataFrame(mixed, "doc_id long, text string"), counts).collect()
    found = {r.doc_id: r for r in rows}
    assert (found[1].languages, found[2].languages, found[3].languages) == (["en"], ["de"], ["en", "de"])
    assert 0.65 < found[3].score < 0.85
    assert [(found[n].lang_pred, found[n].score) for n in (4, 5)] == [("und", 0.0)] * 2


def test_language_edges(spark):
    counts = language_id.learn(edge_documents(spark))
    assert language_id.identify(edge_documents(spark), counts).count() == len(EDGE_TEXTS)
    assert language_id.identify(no_documents(spark), counts).count() == 0
    nothing = language_id.learn(no_documents(spark))
    assert {r.lang_pred for r in language_id.identify(edge_documents(spark), nothing).collect()} == {"und"}


def test_mixtures_equal_a_plain_expectation_maximisation():
    """Every document by itself, every set of languages, term by term."""
    from itertools import combinations

    rng = np.random.default_rng(7)
    n_langs, n_slots = 3, 40
    chances = rng.dirichlet(np.full(n_slots, 0.2), n_langs).T + 1e-4
    chances /= chances.sum(0)
    table = np.full((language_id.SLOTS, n_langs), 1e-6)
    table[:n_slots] = chances
    rows, slots = [], []
    for row in range(25):
        shares = rng.dirichlet([0.4] * n_langs)
        for lang in rng.choice(n_langs, rng.integers(1, 400), p=shares):
            rows.append(row)
            slots.append(rng.choice(n_slots, p=chances[:, lang]))
    rows, slots = np.array(rows), np.array(slots)
    found, share, chosen = language_id.infer(table, slots, rows)
    assert found.tolist() == list(range(25))
    for row in range(25):
        own = [chances[s] for s in slots[rows == row]]
        fee = language_id.PENALTY * math.log(len(own) + 1)

        def em(langs):
            mix = {k: 1 / len(langs) for k in langs}
            for _ in range(language_id.ROUNDS):
                parts = [{k: c[k] * mix[k] for k in langs} for c in own]
                mix = {k: sum(p[k] / sum(p.values()) for p in parts) / len(own) for k in langs}
            return mix, sum(math.log(sum(c[k] * mix[k] for k in langs)) for c in own)

        by_share = sorted(range(n_langs), key=lambda k: -em(range(n_langs))[0][k])
        best = max(combinations(range(n_langs), 1), key=lambda s: em(s)[1])
        value = em(best)[1] - fee
        for size in range(2, n_langs + 1):  # the languages with the greatest shares, while they gain
            langs = by_share[:size]
            if em(langs)[1] - size * fee <= value:
                break
            best, value = langs, em(langs)[1] - size * fee
        assert set(np.flatnonzero(chosen[row]).tolist()) == set(best), row
        if len(best) > 1:
            mix = em(best)[0]
            assert all(math.isclose(share[row, k], mix[k], abs_tol=1e-6) for k in best)


# --- quality -----------------------------------------------------------------------------


def test_isotonic_equals_the_definition():
    rng = np.random.default_rng(1)
    y, w = rng.random(30), rng.integers(1, 5, 30).astype(float)
    found = isotonic(np.arange(30.0), y, w)
    plain = [
        max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(k, 30)) for a in range(k + 1))
        for k in range(30)
    ]
    assert np.allclose(found, plain)


def test_statistics_of_a_text():
    parts = ["Aa bb bb cc!\nAa bb bb cc!\n", "", "été 12 #x"]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])])
    found = [dict(zip(quality_model.FEATURES, row)) for row in quality_model.statistics(data, offsets)]
    assert math.isclose(found[0]["log_words"], math.log1p(8)) and found[0]["echoes"] == 2 / 8
    assert found[0]["dup_lines"] == 0.5 and found[0]["distinct_words"] == 3 / 8 and found[0]["common_word"] == 0.5
    assert found[0]["exclamations"] == 2 / 8 and found[0]["capital_words"] == 2 / 8
    assert all(v == 0 for v in found[1].values())
    assert found[2]["symbols"] == 1 / 3 and math.isclose(found[2]["digits"], 2 / 11)


@pytest.mark.parametrize("name, label, least", [("op7_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, larger, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = QUERIES[name](spark, larger).collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "quality" else 0.5)) for r in rows)
    held_out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert held_out and sum(p == y for p, y in held_out) >= least * len(held_out)


def test_ridge_equals_a_plain_solution(spark):
    rng = np.random.default_rng(5)
    width, n, n_fourier = len(quality_model.FEATURES), 300, 12
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(float)
    learning = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, y)], "x array<double>, label double")
    model = quality_model.fit(learning.repartition(5), n_fourier, ridge=0.3)
    z = model.fourier(x)
    penalty = 0.3 * n / n_fourier
    # The same objective by augmented least squares: the constant is not punished.
    extra = np.sqrt(penalty) * np.eye(n_fourier + 1)
    extra[-1] = 0
    plain = np.linalg.lstsq(np.vstack([z, extra]), np.append(y, np.zeros(n_fourier + 1)), rcond=None)[0]
    assert np.allclose(model.weights, plain, atol=1e-5)
    assert np.all(np.diff(model.chances) >= 0) and ((model.chances >= 0) & (model.chances <= 1)).all()
    assert np.allclose(x.mean(0), model.mean) and np.allclose(x.std(0), model.scale)


def test_quality_edges(spark):
    labels = known(spark, [(5, 1.0), (4, 0.0), (99, 1.0)])
    assert quality_model.classify(edge_documents(spark), labels).count() == len(EDGE_TEXTS)
    unlabelled = quality_model.classify(edge_documents(spark), known(spark, []))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    assert quality_model.classify(no_documents(spark), labels).count() == 0


# --- toxicity ----------------------------------------------------------------------------


def plain_ratios(counts, discount=0.75):
    """Kneser-Ney as the papers define it, from {run: (toxic, ordinary)}, term by term."""
    pooled = {g for g, n in counts.items() if sum(n)}
    tables = {3: Counter(g[1:] for g in pooled)}
    tables[2] = Counter(g[1:] for g in tables[3])
    tables[1] = Counter(g[1:] for g in tables[2])

    def lower(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        table = tables[len(g)]
        context = [n for h, n in table.items() if h[:-1] == g[:-1]]
        if not context:
            return lower(g[1:])
        return (max(table[g] - discount, 0) + discount * len(context) * lower(g[1:])) / sum(context)

    def own(g, k):
        context = [n[k] for h, n in counts.items() if h[:-1] == g[:-1] and n[k]]
        if not context:
            return lower(g[1:])
        return (max(counts.get(g, (0, 0))[k] - discount, 0) + discount * len(context) * lower(g[1:])) / sum(context)

    return {g: (own(g, 0), own(g, 1)) for g in pooled}, own


def test_models_equal_kneser_ney_and_are_distributions(spark):
    rng = random.Random(4)
    counts = Counter()
    for _ in range(300):
        counts[tuple(rng.choices([1, 2, 3, 900, 0x1F642], weights=[5, 3, 2, 1, 1], k=4)), rng.randrange(2)] += 1
    both = {g: (counts[g, 0], counts[g, 1]) for g, _ in counts}
    rows = [(*g, *n) for g, n in both.items()]
    table = spark.createDataFrame(rows, "s0 int, s1 int, s2 int, s3 int, t long, o long")
    expected, own = plain_ratios(both)
    found = toxicity.ratios(table, toxicity.F.col("t"), toxicity.F.col("o")).collect()
    assert len(found) == len(expected)
    for r in found:
        g = (r.s0, r.s1, r.s2, r.s3)
        assert np.allclose((r.toxic_p, r.ordinary_p), expected[g])
        assert math.isclose(r.ratio, math.log(expected[g][0] / expected[g][1]), abs_tol=1e-9)
        unseen = (*g[:3], 77)  # a last symbol that no run has: what is left over, from the same backoff
        assert math.isclose(r.open, math.log(own(unseen, 0) / own(unseen, 1)), abs_tol=1e-9)
    symbols = {g[3] for g in both}
    for context in {g[:3] for g in both}:
        for k in (0, 1):
            # All known last symbols and the share of the unknown one.
            total = sum(own((*context, s), k) for s in symbols) + own((*context, 77), k)
            assert math.isclose(total, 1, abs_tol=1e-9)


def byte_rows(texts):
    raw = [("" if t is None else t).encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_grams_count_every_run():
    texts = ["Ab,  b", None, "", " \n", " é1", "b "]
    columns, rows = toxicity.grams(*byte_rows(texts))
    expected = []
    for row, folded in enumerate(["ab, b", "", "", "", "é1", "b "]):
        padded = "\0\0\0" + folded
        expected += [(row, padded[k : k + 4]) for k in range(len(folded))]
    found = [(r, "".join(map(chr, c))) for r, c in zip(rows.tolist(), columns.tolist())]
    assert found == expected


def test_passages_are_the_highest_means():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 19, 20, 21, 0, 200, 5]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    values = rng.normal(size=len(rows))
    found, at = toxicity.passages(values, rows, len(sizes)), 0
    for n, size in enumerate(sizes):
        own, at = values[at : at + size], at + size
        width = min(size, toxicity.PASSAGE)
        means = [own[k : k + width].mean() for k in range(size - width + 1)] if size else [0.0]
        assert math.isclose(found[n], max(means), abs_tol=1e-9)
    assert toxicity.passages(np.zeros(0), np.zeros(0, int), 2).tolist() == [0.0, 0.0]


def test_counts_meet_over_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1)
    rng = random.Random(2)
    rows = [(n, rng.choice([0.0, 1.0, None]), n % 2, " ".join(rng.choices(["ab", "é", "1488", "x!"], k=9))) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, label double, half int, text string").repartition(3)
    expected = Counter()
    for _, label, half, text in rows:
        columns, _ = toxicity.grams(*byte_rows([text]))
        for c in map(tuple, columns.tolist()):
            if label is not None:
                expected[c, "toxic" if label else "ordinary"] += 1
                expected[c, "toxic_half" if label else "ordinary_half"] += half
    found = Counter()
    for r in toxicity.counts(docs, 5).collect():
        for name in toxicity._COUNTS:
            found[(r.s0, r.s1, r.s2, r.s3), name] += r[name]
    assert +found == +expected


def test_a_model_as_a_table_scores_like_one_in_the_tasks(spark, larger, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(toxicity, "PART_RUNS", 20_000)
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet").selectExpr("doc_id", "double(toxic) AS label")
    found = [sorted(map(tuple, toxicity.classify(docs, labels, model_runs=n).collect())) for n in (10**9, 0)]
    assert [i for i, _ in found[0]] == [i for i, _ in found[1]]
    assert np.allclose([s for _, s in found[0]], [s for _, s in found[1]], atol=1e-4)


def test_toxic_documents_are_found_and_others_left_alone(spark, larger):
    """Recall and precision, which an answer that is always the same does not reach."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_toxicity"](spark, larger).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic = [r for r in rows if labels[r.doc_id]]
    found = [r for r in rows if r.predicted]
    hits = sum(labels[r.doc_id] for r in found)
    assert len(toxic) >= 5 and hits >= 0.8 * len(toxic) and hits >= 0.7 * len(found)


@pytest.mark.parametrize("mark", ["1488", "żmija", "гад", "n0x!"])
def test_digits_signs_and_other_letters_are_told_apart(spark, mark):
    rng = random.Random(8)
    plain = ["house", "река", "2024", "1977", "płot", "1350!", "été", "99"]
    rows = []
    for n in range(400):
        own = rng.choices(plain, k=30)
        if n % 4 == 0:
            own[rng.randrange(30)] = mark
        rows.append((n, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = known(spark, [(n, float(n % 4 == 0)) for n in range(100, 400)])
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert sum(scores[n] >= 0.5 for n in range(0, 100, 4)) >= 24
    assert sum(scores[n] >= 0.5 for n in range(100) if n % 4) <= 2


def test_toxicity_learns_and_edges(spark):
    rng = random.Random(6)
    plain = ["house", "river", "table", "green", "paper", "stone"]
    rows = []
    for n in range(400):
        own = rng.choices(plain, k=40)
        if n % 4 == 0:
            own[rng.randrange(40)] = "vermin"
        rows.append((n, " ".join(own), float(n % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double")
    labels = docs.filter("doc_id >= 100").select("doc_id", "label")
    scores = {r.doc_id: r.score for r in toxicity.classify(docs.drop("label"), labels).collect()}
    assert all((scores[n] >= 0.5) == (n % 4 == 0) for n in range(100))
    assert toxicity.classify(edge_documents(spark), known(spark, [(5, 1.0), (4, 0.0)])).count() == len(EDGE_TEXTS)
    assert {r.score for r in toxicity.classify(edge_documents(spark), known(spark, [])).collect()} == {0.0}
    assert toxicity.classify(no_documents(spark), known(spark, [(5, 1.0), (4, 0.0)])).count() == 0


# --- licenses ----------------------------------------------------------------------------


def test_license_lines_of_the_corpus(spark, larger):
    phrases = {
        "apache-2.0": "Apache License, Version 2.0", "mit": "MIT License", "gpl-3.0": "GNU General Public License, version 3",
        "cc-by-nc-4.0": "CC BY-NC 4.0", "proprietary": "All rights reserved",
    }
    expected = {(d, f) for d, t in texts(spark, larger).items() for f, p in phrases.items() if p in t}
    found = {(r.doc_id, r.family) for r in QUERIES["op10_license_scan"](spark, larger).collect()}
    assert expected and len(expected & found) >= 0.95 * len(expected)
    assert len(found - expected) <= 0.05 * len(expected)


def test_declarations_wrapped_after_every_word(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("aeioubdfglmnrst", k=rng.randrange(3, 9))) for _ in range(400)]
    rows = [(n, "\n".join(" ".join(rng.choices(plain, k=9)) for _ in range(12))) for n in range(200)]
    expected = set()
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            own = template.split(" ")
            for mark, k in [(m, k) for m in ("\n", "\n# ", "\n * ") for k in range(1, len(own))]:
                wrapped = " ".join(own[:k]) + mark + " ".join(own[k:])
                rows.append((len(rows), f"{' '.join(rng.choices(plain, k=6))}\n\n{wrapped}\n\n{' '.join(rng.choices(plain, k=6))}"))
                expected.add((rows[-1][0], family))
    # Inside a paragraph, with other lines right before and after.
    for k, family in ((2, "proprietary"), (1, "proprietary")):
        own = "All rights reserved.".split(" ")
        rows.append((len(rows), f"{' '.join(rng.choices(plain, k=5))}\n{' '.join(own[:k])}\n{' '.join(own[k:])}\n{' '.join(rng.choices(plain, k=5))}"))
        expected.add((rows[-1][0], family))
    found = {(r.doc_id, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(expected & found) >= 0.99 * len(expected)
    assert not any(d < 200 for d, _ in found)


def test_the_reporting_chance_counts_every_window():
    rng = np.random.default_rng(5)
    known = rng.random(100_000)
    counted = [*zip(*(x.tolist() for x in np.unique((known * licenses.BINS).astype(int), return_counts=True)))]
    bound = licenses.chance_passed_by(counted, 0.001)
    assert (known >= bound).mean() <= 0.001 and abs(bound - np.quantile(known, 0.999)) <= 2 / licenses.BINS
    assert licenses.chance_passed_by([], 0.001) == 0.0


def test_chances_of_windows_equal_a_scan_of_each():
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(["the", "license", "of", "mit", "granted", "xyz", "under", "a"], 900)) + "\n"
    data = np.frombuffer((text + text[:300] + "\n\n" + "the the the the\nmit mit").encode(), np.uint8)
    hashes, first, size, _ = licenses.windows(data, np.array([0, len(text), len(data)], np.int64))
    weights, bias = rng.normal(size=(licenses.SLOTS, 4)), rng.normal(size=4)
    found = licenses.class_chances(hashes, first, size, weights, bias)
    assert len(first) > 50
    for k in range(len(first)):
        words = hashes[first[k] : first[k] + size[k]]
        slots = {*licenses.grams(words)[0].tolist()}
        pairs = {*licenses.grams(words)[1].tolist()} if len(words) > 1 else set()
        logits = bias + sum(weights[s] for s in slots) + sum(weights[s] for s in pairs)
        expected = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert np.allclose(found[k], expected)


def test_scan_equals_every_window_by_itself(spark):
    """The agreement of each window with each template as sets of pairs, without shortcuts."""
    rng = random.Random(12)
    plain = ["river", "stone", "under", "the", "license", "granted", "house", "of", "rights"]
    rows = []
    for n in range(80):
        words = rng.choices(plain, k=60)
        if n % 4 == 0:
            family = rng.choice(list(licenses.TEMPLATES))
            words[20:20] = rng.choice(licenses.TEMPLATES[family]).split()
        rows.append((n, " ".join(words).replace("stone", "stone\n", 1)))
    templates = licenses._template_grams()
    agreed: dict[int, set[str]] = {}
    for n, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, first, size, _ = licenses.windows(data, np.array([0, len(data)], np.int64))
        for a, k in zip(first, size):
            words = hashes[a : a + k]
            own = set(licenses.grams(words)[1].tolist()) if k > 1 else set()
            for family, sentences in zip(licenses.TEMPLATES, templates):
                for sentence in sentences:
                    common = len(own & set(sentence.tolist()))
                    share = max(common / len(sentence), common / len(own) if len(own) >= 5 else 0)
                    if share >= licenses.AGREEMENT:
                        agreed.setdefault(n, set()).add(family)
    found: dict[int, set[str]] = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.agreement >= licenses.AGREEMENT
        found.setdefault(r.doc_id, set()).add(r.family)
    assert set(found) == set(agreed)  # every document with a window that agrees, and no other
    assert all(found[n] <= agreed[n] for n in found)


def test_license_in_long_lines_and_edges(spark):
    filler = "plain words without any meaning stand here for a while and then some more of them follow "
    gpl = licenses.TEMPLATES["gpl-3.0"][0]
    rows = [(n, filler * 30, "s") for n in range(20)] + [(100, filler * 9 + gpl + filler * 9, "s")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.family) for r in found} == {(100, "gpl-3.0")}
    assert licenses.scan(edge_documents(spark)).count() == 0
    assert licenses.scan(no_documents(spark)).count() == 0
