"""Learned operators: held-out accuracy, and brute force on small fixtures."""

import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from storytide.llm import common, importance, language, sampling, topk, toxicity

from .frames import ODD, none, odd

DATA = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_fold():
    whole, off = toxicity.fold(["Yоu ID10T, 1d10t! 2024 is 20s", "", "!so", "Ét​é́ $cum"])
    got = [whole[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [" you idiot idiot 2024 is 20s ", " ", " so ", " ete scum "]


def test_lexicon_matching():
    m = toxicity.Model({" idiot ": 3.0, " lowe": 2.0}, ["lowell", "idiot proof"], (-1.0, 2.0, 0.1, 0.0))
    x = m.features(["an IDIOT", "idiotic", "lowest lowell", "idiot proof plan", ""])
    assert x[:, 3].tolist() == pytest.approx([math.log(2), 0, math.log(2), 0, 0])
    assert m.score(["an 1d10t", ""]).tolist() == pytest.approx([1 / (1 + math.exp(1 - 2 * math.log(4) - 0.1 * 30)), 1 / (1 + math.e)])


def test_matching_by_brute_force():
    """Places and weights against a scan of every text for every pattern and exception."""
    rng = random.Random(8)
    parts = ["idiot", "idiotic", "id10t", "lowell", "lowest", "low", "proof", "scum", "sc", "bag", "Scumbag!", "ІDIOT", "ok"]
    m = toxicity.Model({" idiot ": 3.0, " idiot": 1.5, " lowe": 2.0, " scum bag ": 4.0, " scum": 1.0}, ["lowell", "idiot proof"], (-1.0, 2.0, 0.1, 0.0))
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = m.features(texts)
    for t, row in zip(texts, got, strict=True):
        whole, _ = toxicity.fold([t])
        spans = [(s, s + len(e) + 2) for e in m.exceptions for s in range(len(whole)) if whole.startswith(f" {e} ", s)]
        best = {}
        for p, w in m.weights.items():
            for s in range(len(whole)):
                if whole.startswith(p, s) and not any(a <= s and s + len(p) <= b for a, b in spans):
                    best[s] = max(best.get(s, 0), w)
        words = len(whole.split())
        total = sum(best.values())
        assert row.tolist() == pytest.approx([1, math.log1p(total), min(30, total / max(1, words) * 100), math.log1p(len(best))])


@there
def test_toxicity_held_out(spark):
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    m = toxicity.fit(docs, labels)
    s = toxicity.score(docs, m)
    got = s.withColumn("held_out", common.held_out(s["doc_id"])).toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[got.held_out]
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() == 0
    assert (got.predicted == got.toxic).mean() > 0.95
    r = toxicity.score(odd(spark), m).collect()
    assert len(r) == odd(spark).count() and all(0 <= x.score <= 1 for x in r)
    assert toxicity.keep_clean(odd(spark), m).columns == odd(spark).columns
    assert toxicity.score(none(spark), m).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).weights == {}


def test_forward_sums_all_segmentations():
    name = "piece_bpe_32k.model"
    v = language.vocabulary(name)
    rng = np.random.default_rng(1)
    prob = rng.random((len(v.pieces), 2)) / 1000

    def brute(w):
        total = np.zeros((len(w) + 1, 2))
        total[0] = 1
        at = {p: k for k, p in enumerate(v.pieces) if p}
        for j in range(1, len(w) + 1):
            for i in range(j):
                k = at.get(w[i:j], 0 if j - i == 1 else None)
                if k is not None:
                    total[j] += total[i] * prob[k]
        return total[-1]

    words = ["▁the", "▁nation", "▁ёж漢", "▁", "▁zusammen"]
    cp = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words])
    lens = np.array([len(w) for w in words])
    e = v.lattice(cp, lens)
    alpha, beta = language.forward(e, len(words), prob), language.backward(e, len(words), lens, prob)
    for k, w in enumerate(words):
        assert np.allclose(alpha[k, len(w)], brute(w)) and np.allclose(beta[k, 0], brute(w))


def test_long_words_are_summed_whole(monkeypatch):
    """Words beyond LONGEST: the sums of all segmentations, over the borders of stretches, and far below 1e-300."""
    import math
    from fractions import Fraction

    name = "piece_bpe_32k.model"
    v = language.vocabulary(name)
    rng = np.random.default_rng(2)
    prob = rng.random((len(v.pieces), 2)) / 1000
    at = {p: k for k, p in enumerate(v.pieces) if p}

    def brute(w, lang):
        total = [Fraction(1)] + [Fraction(0)] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - v.longest), j):
                k = at.get(w[i:j], 0 if j - i == 1 else None)
                if k is not None:
                    total[j] += total[i] * Fraction(float(prob[k, lang]))
        return math.log(total[-1].numerator) - math.log(total[-1].denominator)

    words = ["donaudampfschifffahrtsgesellschaft", "thenationof" * 9, "ёж漢字" * 20, "ab" * 150, "the" * 11]
    model = language.Model(["aa", "bb"], prob, name)
    for stretch in (7, 4096):
        monkeypatch.setattr(language, "STRETCH", stretch)
        for w in words:
            letters = np.frombuffer(("▁" + w).encode("utf-32-le"), np.uint32)
            assert language.forward_long(v, letters, prob) == pytest.approx([brute("▁" + w, 0), brute("▁" + w, 1)], rel=1e-9)
    cp, starts, ends, _ = language.letter_runs([" ".join(["short", *words, "word"])])
    got = model.word_scores(cp, starts, ends)
    assert got.ravel() == pytest.approx([brute("▁" + w, k) for w in ["short", *words, "word"] for k in (0, 1)], rel=1e-9)
    assert model.predict(["x" * 100_000])[0][0] in ("aa", "bb")


@there
def test_language_held_out(spark):
    docs = common.table(spark, DATA, "documents")
    m = language.fit(docs)
    p = language.predict(docs, m)
    got = p.withColumn("held_out", common.held_out(p["doc_id"])).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98
    r = {x.doc_id: (x.lang_pred, x.score) for x in language.predict(odd(spark), m).collect()}
    assert r[2] == r[3] == r[9] == ("und", 0.0) and r[1][0] == "en"
    assert language.predict(none(spark), m).count() == 0
    empty = language.fit(none(spark))
    assert {x.lang_pred for x in language.predict(odd(spark), empty).collect()} == {"und"}


def test_language_fit_counts_all_words(spark, monkeypatch):
    """A language of rare words beside one of more than 80 000 frequent words: every word of both counts."""
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(5))
    big = [" ".join(name(k) for k in range(a, a + 5000)) for a in range(0, 90_000, 5000) for _ in range(2)]
    small = [" ".join("z" + name(k) for k in range(a, a + 200)) for a in range(0, 2000, 200)]
    rows = [(k, t, "aa" if k < len(big) else "zz") for k, t in enumerate(big + small)]
    seen = {}

    def estimate(counts, *_):
        seen.update(counts)
        return np.full((len(language.vocabulary("piece_bpe_32k.model").pieces), len(counts)), 1e-3)

    monkeypatch.setattr(language, "estimate", estimate)
    m = language.fit(odd(spark, rows), held_out=False)
    assert m.languages == ["aa", "zz"] and m.prob.shape[1] == 2
    want = {lang: Counter(w for _, t, x in rows if x == lang for w in t.split()) for lang in m.languages}
    assert seen == want


@there
def test_importance(spark):
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    m = importance.fit(docs, labels)
    x = importance.resample(docs, m).toPandas()
    k = (x.weight >= m.threshold).sum()
    assert x.selected.sum() == k
    assert set(x[x.selected].doc_id) == set(x.sort_values("key", ascending=False).head(k).doc_id)
    y = x.merge(labels.toPandas(), on="doc_id")
    assert ((~y.selected) & (y.quality == 1)).sum() <= 0.01 * (y.quality == 1).sum()
    assert (y.selected & (y.quality == 0)).sum() <= 0.05 * (y.quality == 0).sum()
    kept = importance.keep_selected(docs, m)
    assert kept.columns == docs.columns and kept.count() == k
    # counts by brute force
    texts = docs.toPandas().text
    want = np.zeros(importance.BUCKETS)
    for t in texts:
        want += np.bincount(importance.grams([t])[0], minlength=importance.BUCKETS)
    assert np.array_equal(importance.counts(docs), want)
    for n in range(len(ODD) + 2):  # exactly k rows, though two are copies
        few = importance.resample(odd(spark), m, n)
        assert few.where("selected").count() == min(n, len(ODD)) == importance.keep_selected(odd(spark), m, n).count() and few.count() == len(ODD)
    assert importance.resample(none(spark), m).count() == 0 and importance.keep_selected(none(spark), m).count() == 0
    assert importance.fit(docs, labels.limit(0)).threshold == -np.inf


def test_weights_by_brute_force():
    """Log weights of n-grams counted one by one."""
    import re

    rng = random.Random(4)
    words = "the cat Sat on 12 mats, (and) slept! Über 日本".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    ratio = np.random.default_rng(1).normal(size=512)
    got, n = importance.weigh(texts, ratio)
    for t, w, k in zip(texts, got, n, strict=True):
        parts = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t)
        g, _ = importance.grams([t], 512)
        assert len(g) == k == max(0, len(parts)) + max(0, len(parts) - 1) + max(0, len(parts) - 2)
        own = [importance.grams([p], 512)[0][0] for p in parts]
        assert g[: len(parts)].tolist() == own and w == pytest.approx(ratio[g].sum())


def test_inclusion_follows_the_weights():
    """Gumbel top-k over seeds against drawing one after another in proportion to the weights."""
    weight = np.array([2.0, 1.0, 0.0, 0.0, -1.0, -3.0])
    ids, texts, k, runs = list(range(6)), list("abcdef"), 3, 6000
    got = np.zeros(6)
    for seed in range(runs):
        got[np.argsort(-(weight + importance.gumbel(ids, texts, seed)))[:k]] += 1
    p = np.exp(weight)
    want = np.zeros(6)
    for order in itertools.permutations(range(6), k):
        left, chance = p.sum(), 1.0
        for i in order:
            chance, left = chance * p[i] / left, left - p[i]
        want[list(order)] += chance
    assert np.abs(got / runs - want).max() < 0.02


def test_labels_that_differ_and_large_ids(spark):
    labels = spark.createDataFrame([(2**53 + 1, 1), (2, 0), (2, 1), (None, 1), (3, 1), (3, 1), (4, 7)], "doc_id long, quality int")
    keys = sampling.agreed(labels, "quality")
    assert sorted(map(tuple, keys.collect())) == [(3, "1"), (2**53 + 1, "1")]
    docs = spark.createDataFrame([(None, "x"), (2**53 + 1, "y"), (2**53, "z"), (3, None)], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in sampling.texts_with(docs, keys, "doc_id", "quality").collect()) == [(3, None, "1"), (2**53 + 1, "y", "1")]


def test_kth_largest(spark):
    rng = random.Random(1)
    v = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [5] * 20 + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in v], "x long")
    for k in (1, 2, 150, 322):
        assert importance.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 0) is None and importance.kth_largest(df, "x", 323) is None


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 100)
    monkeypatch.setattr(topk, "GROUP", 5)
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (600, 12)).round(1)
    rows = [(int(i), x.tolist(), 1, 2) for i, x in enumerate(v)]
    rows += [(700, None, 1, 2), (750, [None] * 12, 1, 2), (800, [float("nan")] * 12, 1, 2), (850, [1.0] * 3, 1, 2), (None, [0.5] * 12, 1, 2), (900, v[0].tolist(), 1, 2), (0, v[0].tolist(), 1, 2), (0, v[5].tolist(), 1, 2), (950, [], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, part int")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float))) for i, x, *_ in rows if i is not None and x is not None and len(x) == 12 and x[0] is not None and np.isfinite(x).all()]
    want = []
    for n, (q, v) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-int(v @ c), i) for m, (i, c) in enumerate(good) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    two = topk.top_k(df.where("vec_id in (50, 1)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(50, 1, 1)]


def test_top_k_of_large_components(spark, monkeypatch):
    """Scores beyond 2^53 are exact, also where they nearly tie; a vector whose products may not fit a long, and one
    whose integers overflow, take no part and disturb no other."""
    monkeypatch.setattr(topk, "PART", 40)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, [float(x) for x in rng.integers(0, 3_000_000, 8)]) for i in range(0, 120)]
    base = [2_000_000.0, 1.0, 1_500_000.0, 3.0, 0.25, 0.5, 7.0, 0.0]
    rows += [(3000 + 50 * i, [*base[:7], i / 256]) for i in range(6)]
    rows += [(5000, [1e16] * 8), (5050, [1e307, *[1.0] * 7]), (5100, [1e38] * 8), (5150, [1.3e7] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i < 5000]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert max(s for *_, s in want) > 2**56
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0]), (100, [1e307, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in topk.top_k(few).collect()) == [(0, 50), (50, 0)]


def test_pruning_saves_work():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(0, 1, (20000, 32)) * np.linspace(2, 0.05, 32))
    v = v[np.argsort(-np.sqrt((v * v).sum(axis=1)))]
    work = {}
    topk.search(v[:50], np.arange(50), np.full(50, -np.inf), v, np.arange(len(v)), np.arange(len(v)), topk.rotation(v[:2000]), 5, work)
    assert work["pairs"] < 0.3 * 50 * len(v)


@there
def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    labels = common.table(spark, DATA, "labels").toPandas()
    rows, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = common.written(stage(spark, rows, DATA), "stage")
        at[name] = rows.toPandas()
    t, q, n, p = (at[name] for name, _ in corpus_pipeline.STAGES)
    assert list(t.columns) == list(q.columns) == list(n.columns) == docs.columns
    assert set(p.doc_id) == set(n.doc_id) < set(q.doc_id) < set(t.doc_id)
    y = pd.DataFrame({"doc_id": sorted(set(docs.toPandas().doc_id) - set(t.doc_id))}).merge(labels, on="doc_id")
    assert (y.toxic == 1).all()
    assert corpus_pipeline.run(spark, DATA).count() == len(p)
