"""Near-duplicate classes against all pairs."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np

from storytide.llm import common, neardup

from .frames import none, odd


def brute(rows, similarity=0.8):
    import re

    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12):
                parent[root(i)] = root(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(root(i), []).append(r[0])
    return sorted(tuple(sorted(v)) for v in out.values())


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 250))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w), "en"))
            k += 1
    chain = [rng.choice(vocab) for _ in range(200)]  # each step is near the one before, the ends are far apart
    for step in range(8):
        rows.append((k, " ".join(chain[step * 6 :]) + " " + " ".join(f"n{step}x{i}" for i in range(step * 2)), "en"))
        k += 1
    return rows + [(k, None, "en"), (k + 1, None, "en"), (k + 2, "", "en"), (k + 3, "", "en"), (k + 4, "%%%", "en"), (k + 5, "one two", "en"), (k + 6, "One two!", "en")]


def test_classes(spark):
    rows = corpus()
    got = {}
    for r in neardup.classes(odd(spark, rows)).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(v)) for v in got.values()) == brute(rows)
    assert all(k == min(v) for k, v in got.items())


def test_keep_one(spark):
    rows = [*corpus(5), (3, "a repeated row", "en"), (3, "a repeated row", "en")]
    docs = odd(spark, rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(brute(rows))


def test_odd_rows(spark):
    assert neardup.classes(odd(spark)).count() == odd(spark).count()
    assert neardup.classes(none(spark)).count() == 0
    assert neardup.keep_one(none(spark)).count() == 0
    r = neardup.classes(odd(spark, [(None, "same words here", "en"), (5, "same words here", "en"), (None, "alone", "en")])).collect()
    assert sorted(str((x.doc_id, x.class_id, x.class_size)) for x in r) == sorted(["(None, 5, 2)", "(5, 5, 2)", "(None, None, 1)"])


def test_large_group_of_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(2000)}" for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"edit{k}"
        rows.append((k, " ".join(w), "en"))
    r = neardup.classes(odd(spark, rows)).collect()
    assert {x.class_id for x in r} == {0} and {x.class_size for x in r} == {300}


def test_repeated_lines(spark):
    """Pairs that differ in how often a line repeats: sets alike, counts far apart."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words, line, times = [(60, 20, 50), (100, 20, 1000), (200, 40, 200)][k % 3]
        own = " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(words))
        said = " ".join(f"l{k}x{rng.randrange(10**6)}" for _ in range(line))
        rows += [(2 * k, f"{own}\n{said}", "en"), (2 * k + 1, f"{own}\n" + "\n".join([said] * times), "en")]
    got = {}
    for r in neardup.classes(odd(spark, rows)).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    want = brute(rows)
    assert len(want) == 60
    assert sorted(tuple(sorted(v)) for v in got.values()) == want


def group_of_copies(seed=3, n=30):
    """Copies of one text, a third of them too far from it, with edits that several share, chains and shorter ones."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(3)}"
        if k % 5 == 0:
            w = w[rng.randrange(25) :]
        if k % 7 == 0:
            w += [f"n{k}x{i}" for i in range(rng.randrange(20))]
        rows.append((k, " ".join(w), "en"))
    return rows


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Single registers as bands: whole groups of copies share buckets, and only pivots and splits settle them."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "MORE", 1.5)
    monkeypatch.setattr(neardup, "PER_TASK", 8)
    rows = group_of_copies()
    docs = odd(spark, rows).selectExpr("doc_id AS id", "text")
    nodes, links, labels = neardup.links(docs, n_bands=6, rows=1)
    label = {bytes(r.node): bytes(r.label) for r in labels.collect()}
    got = {}
    for r in nodes.collect():
        got.setdefault(label.get(bytes(r.node), bytes(r.node)), []).append(r.id)
    want = brute(rows)
    assert 3 < len(want) < 25
    assert sorted(tuple(sorted(v)) for v in got.values()) == want
    pairs = {(bytes(r.a), bytes(r.b)) for r in links.collect()}
    assert all(label[a] == label[b] for a, b in pairs) and len(pairs) >= len(label) - len(set(label.values()))


def test_recall_on_documents(spark):
    """Pairs of documents, exact and near, that end in one class, against all pairs by an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, lists = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in sets[k]:
            lists.setdefault(x, []).append(k)
    near = set()
    for k, own in sets.items():
        shared = Counter(o for x in own for o in lists[x] if o < k)
        near |= {(o, k) for o, n in shared.items() if n >= 0.8 * (len(own) + len(sets[o]) - n) - 1e-9}
    cls = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    caught = sum(cls[a] == cls[b] for a, b in near)
    print(f"recall {caught / len(near):.4f} of {len(near)} pairs")
    assert len(near) > 50 and caught >= 0.99 * len(near)
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    equal = {}
    for k, t in rows:
        near |= {(equal.setdefault(t, k), k)} if t is not None else set()
    for a, b in near:
        parent[root(a)] = root(b)
    assert len({(root(k), cls[k]) for k in cls}) >= len(set(cls.values()))
    assert all(root(k) == root(c) for k, c in cls.items())  # nothing that links do not connect


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 2**63, 400, dtype=np.uint64)
    wa, wb = rng.exponential(1, 300), rng.exponential(1, 300)
    a, _ = neardup.registers(np.zeros(300, np.int64), items[:300], wa, 1, 4096)
    b, _ = neardup.registers(np.zeros(300, np.int64), items[100:], wb, 1, 4096)
    va, vb = np.zeros(400), np.zeros(400)
    va[:300], vb[100:] = wa, wb
    both = np.flatnonzero((va > 0) & (vb > 0))
    want = sum(1 / np.maximum(va / va[x], vb / vb[x]).sum() for x in both)
    assert abs((a == b).mean() - want) < 0.03
    one, drawn = neardup.registers(np.zeros(50_000, np.int64), rng.integers(1, 2**63, 50_000, dtype=np.uint64), np.ones(50_000), 1, 64)
    assert drawn < 52_000  # early termination


def test_groups_of_one_pivot_are_merged(spark):
    """A member that meets its pivot in several groups stands once; groups of other pivots stay apart."""
    rows = [(key, (w, 9, node), node) for key, own in ((1, "abc"), (2, "abd"), (3, "ab"), (4, "cd")) for node, w in zip("abcd", (-9, -5, -4, -3), strict=True) if node in own]
    left = spark.createDataFrame(rows, "key long, m struct<w:long,n:int,node:string>, label string")
    groups = {}
    for r in neardup.merged(left).collect():
        groups.setdefault(r.key, []).append(r.m.node)
    assert sorted("".join(sorted(g)) for g in groups.values()) == ["abcd", "cd"]


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """What rounds write goes by rows: with hundreds of shuffle partitions a few rows are no hundreds of tasks."""
    files = {}

    def written(df, name):
        out = common.written(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "common", SimpleNamespace(written=written, map_arrow=common.map_arrow, texts_of=common.texts_of))
    monkeypatch.setattr(neardup, "SMALL", 3)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = odd(spark, group_of_copies()[:60]).selectExpr("doc_id AS id", "text")
        neardup.links(docs, n_bands=6, rows=1)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert {"buckets", "groups", "pivots", "near-pairs", "shingle-sets"} <= set(files)
    # a union has the files of both of its sides
    assert {k: n for k, n in files.items() if k != "signatures" and n > 2 * cores} == {}
