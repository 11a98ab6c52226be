"""Source mixing: targets against resharing step by step, rounding by its invariants."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from storytide.llm import mixing

from .frames import ODD, none, odd

SCHEMA = "doc_id long, text string, source string"


def reshared(sizes, weights=mixing.WEIGHTS, ceiling=mixing.CEILING):
    """Targets by handing out the excess again until no target is above its ceiling."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if ceiling * sizes[s] < level * weight[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(ceiling * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def sources(rng, n=900):
    names = ["b", "a", "B", "é", "", None, "z", "hot", "x0", "tiny"]
    rows = []
    for k in range(n):
        s = "hot" if k % 3 == 0 else "tiny" if k == 1 else rng.choice(names[:-1])
        rows.append((k, rng.choice([" ", "\n", "\x0b\t"]).join("w\xa0" for _ in range(int(rng.lognormvariate(3, 1.5)))), s))
    return rows


def check(rows, got):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    per, most = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        per[s] += size(t)
        most[s] = max(most[s], size(t))
    want, taken = reshared(per), collections.Counter()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, _ in rows)
    for r in got:
        s = r["source"]
        assert r["source_size"] == per[s]
        assert r["target"] == pytest.approx(want[s])
        times = want[s] / per[s] if per[s] else 0
        assert int(times - 1e-9) <= r["copies"] <= -int(-times // 1) + 1 and r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
    for s in per:
        assert abs(taken[s] - want[s]) <= most[s]
    return taken, want, most


@pytest.mark.parametrize("leaf", [mixing.LEAF, 2])
def test_targets_and_taken(spark, leaf):
    rows = sources(random.Random(3))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), leaf=leaf).collect()
    check(rows, got)


def test_left_over_is_short(spark):
    """Most sources miss their target by their shortest document at most, whatever the longest; the others are those where
    the rest of a leaf could not make up for a long one."""
    rows = sources(random.Random(4), 3000) + [(9000 + k, "w " * 20_000, s) for k, s in enumerate("ab")]
    taken, want, most = check(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    least = {}
    for _, t, s in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", t))
        if n:
            least[s] = min(n, least.get(s, n))
    close = [s for s in want if abs(taken[s] - want[s]) <= least.get(s, 0) + 1e-6]
    assert len(close) >= len(want) / 2 and most["a"] == 20_000


def test_every_document_has_its_chance(spark):
    """Over many mixes of the same lengths, documents are taken as often as their source's share says."""
    rows = [(1000 * r + k, "w " * (1 + 3 * k), f"s{r:03}") for r in range(400) for k in range(12)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1.0,)).collect()
    times = collections.Counter()
    for r in got:
        times[r["doc_id"] % 1000] += r["copies"]
    assert all(r["copies"] == 1 for r in got)  # equal sources keep their size
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(2.0, 3.0)).collect()
    for w, share in ((0, 0.8), (1, 1.2)):
        per = collections.Counter()
        for r in got:
            if int(r["source"][1:]) % 2 == w:
                per[r["doc_id"] % 1000] += r["copies"]
        assert all(abs(per[k] / 200 - share) < 0.15 for k in range(12)), per


def test_reruns_agree(spark):
    rows = sources(random.Random(5), 400) + [(7, "same row here", "a")] * 9 + [(None, None, None)] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(str, mixing.mix(x, leaf=16).collect())) for x in (df.repartition(1), df.repartition(7), df.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2]


def test_pairs_keep_words_and_probabilities():
    rng = random.Random(6)
    for _ in range(200):
        sa, sb, pa, pb = rng.randint(1, 50), rng.randint(1, 50), rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99)
        mean = [0.0, 0.0]
        n = 4000
        for k in range(n):
            a, b = mixing.pair(sa, pa, sb, pb, (k + 0.5) / n)
            assert a * sa + b * sb == pytest.approx(pa * sa + pb * sb)
            assert {a, b} & {0.0, 1.0} and -1e-9 < min(a, b) and max(a, b) < 1 + 1e-9
            mean = [mean[0] + a / n, mean[1] + b / n]
        assert mean == pytest.approx([pa, pb], abs=2e-3)


def test_draws_are_even():
    u = sorted(mixing._draw(a, b, k) for a, b, k in zip(range(-500, 500), range(1000), range(1000), strict=True))
    assert max(abs(x - (k + 0.5) / 1000) for k, x in enumerate(u)) < 0.06


def test_chosen_weights(spark):
    rows = [(k, "a b c d", f"s{k % 4}") for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 0.5), ceiling=2).groupBy("source").agg(F.max("target").alias("target"), F.sum("copies").alias("copies")).collect()
    assert len(got) == 4
    for r in got:
        words = 1600 / 3 if r["source"] in ("s0", "s2") else 800 / 3
        assert (r["target"], r["copies"]) == (pytest.approx(words), pytest.approx(words / 4, abs=1))


def test_repeated(spark):
    rows = sources(random.Random(8), 200) + [(7, "same row here", "a")] * 4
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS copies")
    mixed = mixing.mix(docs)
    want = collections.Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.repeated(docs, mixed).collect()
    assert collections.Counter(r["doc_id"] for r in out) == want
    assert len({(r["doc_id"], r["text"], r["source"], r["copy"]) for r in out}) == len(out)


def test_odd_documents(spark):
    rows = [(d, t, s) for d, t, s in ODD]
    got = mixing.mix(odd(spark).withColumnRenamed("lang", "source").selectExpr("*", "1 AS tag", "2 AS n", "3 AS target", "4 AS leaf")).collect()
    check(rows, got)
    assert mixing.digest(none(spark).withColumnRenamed("lang", "source")).collect() == []
    nulls = spark.createDataFrame([(1, None, None), (None, "", "a")], SCHEMA)
    assert {(r["source_size"], r["target"], r["taken"]) for r in mixing.digest(nulls).collect()} == {(0, 0.0, 0)}
