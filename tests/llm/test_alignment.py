"""Alignment against the libraries' tokens and a plain loop over bytes."""

import collections
import hashlib
import random

import pytest

from storytide.llm import alignment, bpe

from .frames import ODD, none, odd

RNG = random.Random(2)
ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "é", "漢字", "👍", "<s>", "<|endoftext|>", "<unk>", "12", "ing", ".", "'s", "\x00", "ab" * 9, "</s>"]
TEXTS = ["", "a", " ", "       ", "▁a", "x▁", " lead", "trail ", "<0x41>", "漢" * 40, "=" * 300 + "a", "ab" * 700, " " * 130 + "x", "　wide "] + ["".join(RNG.choices(ALPHABET, k=RNG.randint(0, 40))) for _ in range(400)]


def tokens(text):
    A, B = alignment.encoders("byte_bpe_50k.json", "piece_bpe_32k.model")
    a_lib, b_lib = bpe.library_tokenizer("byte_bpe_50k.json"), B.library
    a_lib.encode_special_tokens = True
    try:
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    finally:
        a_lib.encode_special_tokens = False
    return [(i, A.token[i]) for i in a], [(i, B.token[i]) for i in b]


def cut(text):
    """[(a ids, b ids)] of a text's groups."""
    if not text:
        return []
    a, b = tokens(text)
    raw = (" " + text).encode()
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return []
    ends = []
    for own in (a, b):
        at, out = 0, {}
        for i, t in own:
            at += len(t)
            out[at] = i
        ends.append(out)
    out, now = [], ([], [])
    for k in range(1, len(raw) + 1):
        for side in (0, 1):
            if k in ends[side]:
                now[side].append(ends[side][k])
        if k in ends[0] and k in ends[1]:
            out.append(now)
            now = ([], [])
    assert now == ([], [])
    return out


def brute(rows):
    made, held = [(d, cut(t)) for d, t in rows], collections.Counter()
    links = []
    for _, gs in made:
        own = collections.Counter((i, j) for a, b in gs for i in a for j in b)
        held.update(own.keys())
        links.append(own)
    top = collections.Counter()
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for (d, gs), own in zip(made, links, strict=True):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        best = sum(n for p, n in own.items() if held[p] == top[p[0]])
        out.append((d, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(own.values()), best, sum(n * held[p] for p, n in own.items()), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_pieces_match_library():
    e = bpe.PieceBPE("piece_bpe_32k.model")
    texts = [t for t in TEXTS if "▁" not in t]
    ids, off = e.encode([" " + t for t in texts if t])
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.library.encode(t) for t in texts if t]


@pytest.mark.parametrize("wide", [alignment.WIDE, 3])
def test_block_matches_bytes(wide, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", wide)
    x = alignment.Aligned(TEXTS)
    text, code, n = x.links()
    for k, t in enumerate(TEXTS):
        gs = cut(t)
        own = collections.Counter((i, j) for a, b in gs for i in a for j in b)
        on = text == k
        assert dict(zip(zip((code[on] >> 15).tolist(), (code[on] & 32767).tolist(), strict=True), n[on].tolist(), strict=True)) == own
        assert x.listed()[k].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
    assert any("▁" in t for t in TEXTS)


def test_overlaps():
    x = alignment.Aligned(["unbelievable tokenisation", "", "漢字"])
    for i, j in zip(*x.overlaps, strict=True):
        assert x.a_group[i] == x.b_group[j]
    a_end, b_end = x.A.byte_len[x.a].cumsum(), x.B.byte_len[x.b].cumsum()
    want = [(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if max(a_end[i] - x.A.byte_len[x.a[i]], b_end[j] - x.B.byte_len[x.b[j]]) < min(a_end[i], b_end[j])]
    assert sorted(zip(*(o.tolist() for o in x.overlaps), strict=True)) == want
    assert x.overlap_off.tolist()[-1] == len(want)


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 50])
def test_corpus_matches_brute_force(spark, chunk):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, "the same text"), (5, "the same text"), (None, "no id"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(docs, chunk=chunk)) == brute(rows)


def test_odd_documents(spark):
    docs = odd(spark).selectExpr("*", "1 AS chunk", "2 AS n", "3 AS at")
    assert rows_of(alignment.align(docs)) == brute([(d, t) for d, t, _ in ODD])
    assert alignment.align(none(spark)).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment.align(nulls)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups(spark):
    rows = [(1, "unbelievable tokenisation"), (2, ""), (3, "a▁"), (4, "漢字 and more")]
    got = alignment.groups(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "nth").collect()
    assert [(r["doc_id"], r["nth"], (r["a_ids"], r["b_ids"])) for r in got] == [(d, k, g) for d, t in rows for k, g in enumerate(cut(t))]
