"""Cross-tokenizer alignment by byte-owner arrays.

The tokens of two tokenizers A and B cover the same bytes. np.repeat writes the index of its token over each byte, for A
and for B; consecutive distinct pairs of owners are the overlaps, and where both owners change at once, a cut ends a
group. All A and B tokens of a group are linked.

How many documents hold a linked pair of ids is counted over the corpus without a row per document and pair: a task
gathers documents to chunks of a bounded number of characters, each chunk lists its distinct pairs once with how many
of its documents hold them, and keeps its documents' pairs as numbers into that list. Only the lists are shuffled: to
add up the counts, and back to their chunks, which then sum their documents.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textvec as tv
from .bpe import ByteBPE, PieceBPE

#: Characters after which a chunk is closed; its last text may reach beyond.
CHUNK = 8_000_000
#: Links of a group from which its distinct ids are paired instead of its tokens.
WIDE = 4096
#: Bits of a B id in a pair's code.
BITS = 15
#: Words and letters that each of the two encoders' tables keeps: two tables share a worker's memory.
TABLE = (100_000, 1 << 21)


@functools.cache
def encoders(a_name: str, b_name: str) -> tuple[ByteBPE, PieceBPE]:
    a, b = ByteBPE(a_name), PieceBPE(b_name)
    a.most = b.most = TABLE
    return a, b


def _spelled(encoder, ids: np.ndarray) -> np.ndarray:
    """The bytes of the tokens in a row."""
    return encoder.byte_flat[tv.ragged(encoder.byte_at[ids], encoder.byte_len[ids])]


def _same_bytes(encoder, ids: np.ndarray, off: np.ndarray, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether each text's tokens spell its bytes, data[cut[k] : cut[k + 1]]."""
    size = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(encoder.byte_len[ids], out=size[1:])
    same = size[off[1:]] - size[off[:-1]] == np.diff(cut)
    on = np.flatnonzero(same)
    own = _spelled(encoder, ids[tv.ragged(off[on], (off[1:] - off[:-1])[on])])
    lens = np.diff(cut)[on]
    differ = own != data[tv.ragged(cut[on], lens)]
    if differ.any():
        same[on[np.logical_or.reduceat(differ, np.cumsum(lens) - lens)]] = False  # no text is empty
    return same


class Aligned:
    """The aligned tokens of a block of texts.

    a, b: the ids of all texts in a row, which no text has where its tokens don't spell it; a_off, b_off: the texts'
    offsets; a_group, b_group: each token's group, counted through; group_off: the texts' first groups; overlaps:
    places in a and b of the tokens that share bytes; overlap_off: the texts' first overlaps.
    """

    def __init__(self, texts: list[str], a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> None:
        self.A, self.B = encoders(a_name, b_name)
        there = np.array([bool(t) for t in texts], bool)
        spaced = [" " + t for t in texts if t]
        raw = [t.encode() for t in spaced]
        data, cut = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        a, a_off = self.A.encode(spaced, plain=True)
        b, b_off = self.B.encode(spaced)
        good = _same_bytes(self.A, a, a_off, data, cut) & _same_bytes(self.B, b, b_off, data, cut)
        there[there] = good
        self.a, self.a_off = self._kept(a, a_off, good, there)
        self.b, self.b_off = self._kept(b, b_off, good, there)
        self._groups(there, np.diff(cut)[good])

    @staticmethod
    def _kept(ids, off, good, there):
        lens = np.diff(off)
        n = np.zeros(len(there) + 1, np.int64)
        n[1:][there] = lens[good]
        return ids[np.repeat(good, lens)].astype(np.int64), np.cumsum(n)

    def _groups(self, there, sizes) -> None:
        len_a, len_b = self.A.byte_len[self.a], self.B.byte_len[self.b]
        owner_a, owner_b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (len_a, len_b))
        new_a, new_b = (np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]) for x in (owner_a, owner_b))
        pairs = np.flatnonzero(new_a | new_b)
        self.overlaps = owner_a[pairs], owner_b[pairs]
        cuts = np.flatnonzero(new_a & new_b)  # the first bytes of groups
        self.a_group, self.b_group = (np.searchsorted(cuts, np.cumsum(x) - x, side="right") - 1 for x in (len_a, len_b))
        begins = np.zeros(len(there) + 1, np.int64)
        begins[1:][there] = sizes
        begins = np.cumsum(begins)
        self.group_off, self.overlap_off = np.searchsorted(cuts, begins), np.searchsorted(pairs, begins)
        self.n_a, self.n_b = (np.bincount(x, minlength=len(cuts)) for x in (self.a_group, self.b_group))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, n), sorted: the distinct linked pairs of each text as a << BITS | b, and how many links each has."""
        text_of = np.repeat(np.arange(len(self.group_off) - 1), np.diff(self.group_off))
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        wide = (self.n_a * self.n_b) > WIDE
        plain = ~wide[self.a_group] if len(self.a_group) else np.empty(0, bool)
        owner, beside = self.a_group[plain], self.n_b[self.a_group[plain]]
        other = self.b[tv.ragged(first_b[owner], beside)]
        codes = [np.repeat(text_of[owner], beside) << 32 | np.repeat(self.a[plain], beside) << BITS | other]
        times = [np.ones(len(other), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            (a, k), (b, m) = (np.unique(x[f[g] : f[g] + n[g]], return_counts=True) for x, f, n in ((self.a, first_a, self.n_a), (self.b, first_b, self.n_b)))
            codes.append((int(text_of[g]) << 32 | a[:, None] << BITS | b[None, :]).ravel())
            times.append((k[:, None] * m[None, :]).ravel())
        codes, times = np.concatenate(codes), np.concatenate(times)
        if not len(codes):
            return codes, codes, times
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first] >> 32, codes[first] & 0xFFFFFFFF, np.add.reduceat(times[order], first)

    def listed(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2` of each text: the ids of its groups."""
        side = np.concatenate([self.a_group * 2, self.b_group * 2 + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([self.a, self.b])[order]
        digits = (1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))) + 1  # and what separates
        ends = np.cumsum(digits)
        out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), np.uint8)
        at, rest = ends - 2, ids.copy()
        on = np.arange(len(ids))
        while len(on):
            out[at[on]] = ord("0") + rest[on] % 10
            rest[on] //= 10
            at[on] -= 1
            on = on[rest[on] > 0]
        last = np.flatnonzero(np.concatenate([side[1:] != side[:-1], np.ones(min(len(side), 1), bool)]))
        out[ends[last] - 1] = np.where(side[last] % 2 == 0, ord("|"), ord(";"))
        cut = np.concatenate([[0], ends])[self.a_off + self.b_off]
        data = out.tobytes()
        return [data[x : max(x, y - 1)] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _packed(x: np.ndarray, kind: str) -> bytes:
    return pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), kind)


FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_pairs")
CHUNKED = "chunk long, doc_id array<long>, facts binary, hashes binary, n int, codes binary, held binary, total long, steps binary, times binary"


class _Chunk:
    """Documents of one chunk: their facts, and their pairs as numbers into the chunk's list of distinct pairs."""

    def __init__(self) -> None:
        self.doc_id, self.facts, self.hashes, self.codes, self.times, self.size = [], [], [], [], [], 0

    def add(self, doc_id: list, texts: list[str], names: tuple[str, str]) -> None:
        x = Aligned(texts, *names)
        text, code, n = x.links()
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        run = np.concatenate([[0], np.cumsum(n)])
        self.facts.append(np.stack([np.diff(x.a_off), np.diff(x.b_off), np.diff(x.group_off), run[ends[1:]] - run[ends[:-1]], np.diff(x.overlap_off), np.diff(ends)], 1))
        self.hashes += [hashlib.sha256(s).digest() if s else bytes(32) for s in x.listed()]
        self.doc_id += doc_id
        self.codes.append(code)
        self.times.append(n)
        self.size += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        codes, times, facts = np.concatenate(self.codes), np.concatenate(self.times), np.concatenate(self.facts)
        own, at = np.unique(codes, return_inverse=True)
        held = np.bincount(at, minlength=len(own))  # a document has a pair once
        steps = np.diff(at, prepend=0)  # pairs of a document are sorted, so that steps are small
        vals = (number, self.doc_id, _packed(facts, "<i8"), b"".join(self.hashes), len(own), _packed(np.diff(own, prepend=0), "<u4"), _packed(held, "<u4"), len(codes), _packed(steps, "<i4"), _packed(times, "<i8"))
        types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals, types, strict=True)], [c.split()[0] for c in CHUNKED.split(", ")])


def chunks(docs: DataFrame, a_name: str, b_name: str, chunk: int = CHUNK) -> DataFrame:
    """One row a chunk of aligned documents (CHUNKED). Chunk numbers follow tasks, so the result must be written before use."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        number, now = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            doc_id, texts = b.column(0).to_pylist(), common.texts_of(b.column(1))
            for first, last in tv.blocks(texts):
                now.add(doc_id[first:last], texts[first:last], (a_name, b_name))
                if now.size >= chunk:
                    yield now.row(number)
                    number, now = number + 1, _Chunk()
        if now.doc_id:
            yield now.row(number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNKED)


def _pairs(made: DataFrame) -> DataFrame:
    """chunk, at, a, b, n: the distinct pairs of each chunk, their places in its list and how many of its documents hold them."""

    def run(batches):
        for batch in batches:
            for chunk, n, codes, held in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                code = np.cumsum(_unpacked(codes, n, "<u4"), dtype=np.int64)
                cols = [np.full(n, chunk), np.arange(n, dtype=np.int32), (code >> BITS).astype(np.int32), (code & ((1 << BITS) - 1)).astype(np.int32), _unpacked(held, n, "<u4").astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["chunk", "at", "a", "b", "n"])

    return made.select("chunk", "n", "codes", "held").mapInArrow(run, "chunk long, at int, a int, b int, n long")


def counts(pairs: DataFrame) -> DataFrame:
    """a, b, n, best: in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    per = common.written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "align-counts")
    top = F.broadcast(per.groupBy("a").agg(F.max("n").alias("top")))  # a row an A id: the size of A's vocabulary at most
    return per.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long, n_pairs long"


def align(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", chunk: int = CHUNK) -> DataFrame:
    """Per document: its tokens, groups and links, links by the corpus-wide count of their id pair, the hash of its groups.

    docs: doc_id, text; other columns are ignored. Null and empty texts, and those that the tokens of A or B don't spell,
    have zeros and ''. Each row is a document, repeated rows too; a null doc_id stays null; an empty table gives no rows.
    A task holds one chunk and one text, of whatever length.
    """
    made = common.written(chunks(docs, a_name, b_name, chunk), "align-chunks")
    pairs = _pairs(made)
    known = pairs.drop("n").join(counts(pairs), ["a", "b"]).select("chunk", "at", "n", "best")

    def run(own: pa.Table, listed: pa.Table) -> pa.Table:
        fields = [c.split() for c in OUT.split(", ")]
        types = [pa.int64() if t == "long" else pa.string() for _, t in fields]
        row = {c: own.column(c).to_pylist()[0] for c in own.column_names if c != "doc_id"}
        doc_id = own.column("doc_id").combine_chunks().flatten()
        facts = _unpacked(row["facts"], len(doc_id) * len(FACTS), "<i8").reshape(-1, len(FACTS))
        n, best = np.zeros(row["n"], np.int64), np.zeros(row["n"], np.int64)
        at = listed.column("at").to_numpy()
        n[at], best[at] = listed.column("n").to_numpy(), listed.column("best").to_numpy().astype(np.int64)
        pair, times = np.cumsum(_unpacked(row["steps"], row["total"], "<i4"), dtype=np.int64), _unpacked(row["times"], row["total"], "<i8")
        ends = np.concatenate([[0], np.cumsum(facts[:, 5])])
        sums = [np.concatenate([[0], np.cumsum(times * x[pair])]) for x in (best, n)]
        n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
        hashes = [row["hashes"][k : k + 32].hex() if a else "" for k, a in zip(range(0, len(row["hashes"]), 32), facts[:, 0].tolist(), strict=True)]
        cols = [doc_id, facts[:, 0], facts[:, 1], facts[:, 2], facts[:, 3], n_best, count_sum, hashes, facts[:, 4], facts[:, 5]]
        return pa.Table.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(cols, types, strict=True)], [c for c, _ in fields])

    common.ship(docs.sparkSession)
    return made.drop("codes", "held").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, OUT)


def groups(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, nth, a_ids, b_ids: the groups of every document, one row each, in order; documents without tokens have none."""

    def run(b):
        doc_id, texts, cols = b.column(0).to_pylist(), common.texts_of(b.column(1)), ([], [], [], [])
        for first, last in tv.blocks(texts):
            x = Aligned(texts[first:last], a_name, b_name)
            for k in range(first, last):
                nth = np.arange(x.group_off[k - first + 1] - x.group_off[k - first])
                cols[0].extend([doc_id[k]] * len(nth))
                cols[1].append(nth)
            cols[2].extend(g.tolist() for g in np.split(x.a, np.cumsum(x.n_a)[:-1]) if len(x.n_a))
            cols[3].extend(g.tolist() for g in np.split(x.b, np.cumsum(x.n_b)[:-1]) if len(x.n_b))
        nth = np.concatenate(cols[1]) if cols[1] else np.empty(0, np.int64)
        ids = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(nth, pa.int64()), pa.array(cols[2], ids), pa.array(cols[3], ids)], ["doc_id", "nth", "a_ids", "b_ids"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, nth long, a_ids array<int>, b_ids array<int>")
