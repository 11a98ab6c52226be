"""BPE, packing and token files against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from storytide.llm import bpe, encoding, packing, token_files

from .frames import ODD, none, odd

RNG = random.Random(1)
ALPHABET = "a'sStTdmrevl 1\n\t.!é漢Σ<|́ \x1c\x85"
TEXTS = [t or "" for _, t, _ in ODD] + ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(1500)]


@pytest.mark.parametrize(("make", "name"), [(bpe.word_encoder, "word_bpe_49k.json"), (bpe.byte_encoder, "byte_bpe_50k.json")])
def test_encoders_match_library(make, name):
    e, lib = make(name), bpe.library_tokenizer(name)
    ids, off = e.encode(TEXTS)
    want = [x.ids for x in lib.encode_batch(TEXTS, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    if make is bpe.byte_encoder:
        assert e.decode(ids, off) == [lib.decode(w, skip_special_tokens=False) for w in want]
        assert e.seen > e.failed > 0  # both ways were taken


@pytest.mark.parametrize(("make", "name"), [(bpe.WordBPE, "word_bpe_49k.json"), (bpe.ByteBPE, "byte_bpe_50k.json")])
def test_words_with_one_hash(make, name):
    """Words of the Thue-Morse pattern and their mirrors, words that are made to collide, and added tokens between."""
    e, lib = make(name), bpe.library_tokenizer(name)
    texts, word = [], "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 1024:
            mirror = word.translate(str.maketrans("ab", "ba"))
            texts += [word, mirror, f"{mirror} {word} {mirror}"]
    texts += ["one<|endoftext|>two <|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> it's", "É<|endoftext|>\u0301", "a <|startoftext|>b"]
    for hashes in (e.hashes, lambda cp, s, t: (t - s).astype(np.uint64), lambda cp, s, t: np.full(len(s), 5, np.uint64)):
        e.hashes, e.table = hashes, bpe._Table()
        for _ in range(2):  # words are new, then known
            ids, off = e.encode(texts + TEXTS[:200])
            want = [x.ids for x in lib.encode_batch(texts + TEXTS[:200], add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want


def test_compatible_pairs_are_those_that_merging_leaves():
    e = bpe.byte_encoder("byte_bpe_50k.json")
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    good = e.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        raw = np.frombuffer(e.token[x] + e.token[y], np.uint8)
        ids, _ = e.merges.run(e.byte[raw], np.array([len(raw)]))
        assert ok == (ids.tolist() == [x, y])


def test_encode_digest(spark):
    lib = bpe.library_tokenizer("byte_bpe_50k.json")
    got = sorted(map(tuple, encoding.digest(odd(spark)).collect()), key=str)
    want = []
    for i, t, _ in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encoding.digest(none(spark)).count() == 0
    back = encoding.decode(encoding.encode(odd(spark)))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in ODD), key=str)


def check_plan(counts, capacity=2048, groups=packing.GROUPS):
    intervals, n = packing.plan(counts, capacity, groups)
    seqs, seen = {}, {}
    for length, rank, k, seq, offset in intervals:
        for j in range(k):
            seqs.setdefault(seq + j, []).append((offset, length))
            seen.setdefault(length, set()).add(rank + j)
    assert {k: len(v) for k, v in seen.items()} == {k: c for k, c in counts.items() if c}
    assert all(v == set(range(len(v))) for v in seen.values())
    for v in seqs.values():
        at = 0
        for o, length in sorted(v):
            assert o == at
            at += length
        assert at <= capacity
    assert set(seqs) == set(range(n))
    return n


def test_plans():
    assert check_plan({}) == 0
    assert check_plan({2048: 3}) == 3
    assert check_plan({1: 5000}) == 3
    assert check_plan({1025: 100}) == 100
    assert check_plan({683: 999, 1366: 10}) == 510
    assert check_plan({700: 5000, 1400: 4000, 3: 2}) <= 6502
    rng = np.random.default_rng(1)
    for n, groups in ((50, 8), (3000, 64), (3000, 128), (60000, 128)):
        lengths = 1 + rng.lognormal(6, 1.2, n).astype(int) % 2048
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        used, bound = check_plan(counts, groups=groups), -(-int(lengths.sum()) // 2048)
        assert used <= bound * (1.03 if groups > 8 else 1.15) + 2
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_few_sizes(monkeypatch):
    """Large lengths are rounded up to at most as many sizes as there are groups, in groups of equal cardinality."""
    asked = []
    exact = packing.configurations
    monkeypatch.setattr(packing, "configurations", lambda sizes, counts, capacity: asked.append((sizes, dict(counts))) or exact(sizes, counts, capacity))
    lengths = 1 + np.random.default_rng(2).lognormal(6, 1.2, 50_000).astype(int) % 2048
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    for groups in (16, 64, 128):
        check_plan(counts, groups=groups)
        sizes, pieces = asked.pop()
        large = sum(n for k, n in counts.items() if k > 128)
        assert len(sizes) <= groups and sum(pieces.values()) == large
        assert all(n % -(-large // groups) == 0 for s, n in pieces.items() if s != min(sizes))


def test_configurations():
    """Against the best of all configurations: the fractional optimum of thirds and halves, and no piece too many."""
    assert sum(t for _, t in packing.configurations([1024, 683, 341], {1024: 60, 683: 100, 341: 100}, 2048)) <= 30 + 51
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = sorted({int(x) for x in rng.integers(130, 2049, 12)}, reverse=True)
        counts = {s: int(rng.integers(1, 400)) for s in sizes}
        got = packing.configurations(sizes, counts, 2048)
        for s in sizes:
            assert sum(uses.get(s, 0) * times for uses, times in got) <= counts[s]
        assert all(sum(s * n for s, n in uses.items()) <= 2048 for uses, _ in got)
        assert sum(counts.values()) - sum(n * times for uses, times in got for n in uses.values()) <= 16 * len(sizes)


def test_pack(spark):
    lib = bpe.library_tokenizer("word_bpe_49k.json")
    rows = packing.pack(odd(spark), keep_ids=True).collect()
    docs = {}
    for i, t, _ in ODD:
        docs.setdefault(i, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 <= 2048 and r.start == r.piece * 2048
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in pieces.items():
        assert sum(len(p) for _, p in own) == sum(map(len, docs[i]))
        if len(docs[i]) == 1:
            assert [x for _, p in sorted(own) for x in p] == docs[i][0]
    for v in seqs.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert packing.pack(none(spark)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7] * 300, list(range(1000)), [5] * 250 + [2**32 - 1] * 6 + [1], [2**32 - 1, 0] * 200])
def test_blocks(values):
    x = np.array(values, np.uint32)
    data = b"head" + token_files.write_blocks(x)
    got, at = token_files.read_blocks(data, 4)
    assert got.tolist() == values and at == len(data)
    for k in range(-(-len(values) // token_files.BLOCK)):
        assert token_files.read_block(data, 4, k).tolist() == values[k * 256 : (k + 1) * 256]


def test_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    files = token_files.write(odd(spark))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(files).collect()]
    lib = bpe.library_tokenizer("word_bpe_49k.json")
    want, at = [], 0
    for i, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read(token_files.write(none(spark))).count() == 0
    with pytest.raises(ValueError):
        token_files.read_file(b"xxxx")
