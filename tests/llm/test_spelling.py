"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from storytide.llm import spelling

from .frames import none, odd


def near(x, y):
    """Whether one inserted, deleted or replaced letter parts the words."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(rows, slips, letters=6, seen=5, ratio=5):
    lower, n = str.maketrans(spelling.UPPER, spelling.LOWER), collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= seen}
    forms, out = {}, []
    close = {w: [v for v in n if near(w, v)] for w in n}
    for w, own in close.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(close[w]), n.get(forms[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def garbled(rng, n_docs=150):
    """Documents over words that are near each other: runs of one letter, near words at all places, rare slips."""
    base = ["aaaaaa", "aaaaaaa", "letter", "letters", "lettre", "ÀÉÿ÷×abc", "stationary", "stationery", "abcdefghijklmnopqrstuvwxyz"]
    for _ in range(60):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        base.append(rng.choice([w[:k] + rng.choice("abtÀÿé") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:]]))
    weights = [3 ** rng.randint(0, 5) for _ in base]
    return [(k, " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(base, weights, k=60)) + "1short2É.x") for k in range(n_docs)]


@pytest.mark.parametrize("room", [spelling.ROOM, 3])
def test_groups_match_brute_force(spark, room):
    """Also with so little room that windows are halved down to one place."""
    rows = garbled(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.with_slips(spelling.runs(docs), 19)
    got = rows_of(spelling.group(spelling.vocabulary(found), room=room))
    want = brute(rows, 19)
    assert got == want
    assert any(r[1] for r in want)
    assert any(r[4] > 3 for r in want)


def test_chain_of_forms(spark):
    words = [("abcdefghijk"[: 6 + k], 5 * 6**k) for k in range(5)]
    got = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {w: words[-1][0] for w, _ in words}


def test_ties_and_ratio(spark):
    words = [("kitten", 5), ("kittex", 25), ("kittea", 25), ("mitten", 24), ("lonely", 9), ("parted", 5), ("partex", 24)]
    got = {r["word"]: (r["form"], r["form_n"], r["n_near"]) for r in spelling.group(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["kitten"] == ("kittea", 25, 3)
    assert got["lonely"] == (None, None, 0)
    assert got["parted"] == (None, None, 1)  # 24 is less than five times 5
    assert got["kittex"] == (None, None, 2)


def test_odd_documents(spark):
    from .frames import ODD

    assert rows_of(spelling.variants(odd(spark), 199)) == brute([(d, t) for d, t, _ in ODD], 199)
    assert spelling.variants(none(spark)).collect() == []


def test_documents(spark):
    import pyarrow.parquet as pq

    from storytide.llm import registry

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    want = brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)), 199)
    assert rows_of(registry.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == want
