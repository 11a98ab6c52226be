"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer. Each language has a probability
for every piece; the probability of a word is the sum, over all ways to cut it
into pieces, of the product of their probabilities. A forward pass computes that
sum, for all new words of a block at once. A text's score is the sum of its
words' log probabilities, so words met before cost one look-up. The piece
probabilities are estimated by expectation-maximisation, which sums over all
segmentations too, from word counts of a bounded sample of texts per language.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textvec as tv
from .bpe import tokenizer_file

#: Texts that a language is learned from, at most.
FIT_TEXTS = 1_500
#: Rounds of expectation-maximisation.
ROUNDS = 4
#: Letters of a word up to which words are scored together; longer ones are scored one by one, whole. Estimation cuts
#: runs of letters there.
LONGEST = 32
#: Letters of a long word whose pieces are looked up at once.
STRETCH = 4096
#: Entries of a worker's word table before it is begun anew.
TABLE_WORDS = 300_000
UNDETERMINED = "und"
_BEGIN = 0x2581


class Vocabulary:
    """The lower-case pieces of letters of a sentencepiece model, in a trie; piece 0 is any single letter."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        cls = tv.classes()
        found = set()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            body = p.lstrip("▁")
            if p == "▁" or (body and len(p) - len(body) < 2 and body == body.lower() and all(cls[ord(c)] == tv.LETTER for c in body)):
                found.add(p)
        self.pieces = ["", *sorted(found)]
        nodes, ends = {}, [-1]
        for k, p in enumerate(self.pieces):
            at = 0
            for c in p:
                key = (at << 21) | ord(c)
                if (to := nodes.get(key)) is None:
                    to = nodes[key] = len(ends)
                    ends.append(-1)
                at = to
            if p:
                ends[at] = k
        self.trie = tv.HashIndex(1 << 17)
        self.trie.add(np.array(list(nodes), np.uint64) + np.uint64(1), np.array(list(nodes.values()), np.int64))
        self.ends = np.array(ends, np.int64)
        self.longest = max(map(len, self.pieces))

    def lattice(self, cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (word, start, end, piece) of all segmentations, by end and word. cp: the letters of all words in a row."""
        n, stop = len(cp), np.repeat(np.cumsum(lens), lens)
        word = np.repeat(np.arange(len(lens)), lens)
        first = (np.cumsum(lens) - lens)[word]
        on, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        single = np.zeros(n, bool)
        start, size, piece = [], [], []
        while len(on):
            node = self.trie.get(((node.astype(np.uint64) << np.uint64(21)) | cp[on + depth]) + np.uint64(1))
            on, node = on[node >= 0], node[node >= 0]
            depth += 1
            hit = self.ends[node] >= 0
            start.append(on[hit])
            size.append(np.full(int(hit.sum()), depth, np.int64))
            piece.append(self.ends[node[hit]])
            if depth == 1:
                single[on[hit]] = True
            more = on + depth < stop[on]
            on, node = on[more], node[more]
        rest = np.flatnonzero(~single)
        start, size, piece = (np.concatenate(x) for x in ([*start, rest], [*size, np.ones(len(rest), np.int64)], [*piece, np.zeros(len(rest), np.int64)]))
        w = word[start]
        a = start - first[start]
        order = np.lexsort((w, a + size))
        return w[order], a[order], (a + size)[order], piece[order]


@functools.cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def forward(edges, n_words: int, prob: np.ndarray) -> np.ndarray:
    """alpha[word, letters covered, language]: summed probability of all segmentations so far."""
    w, a, e, p = edges
    top = int(e.max(initial=0))
    alpha = np.zeros((n_words, top + 1, prob.shape[1]))
    alpha[:, 0] = 1
    cut = np.searchsorted(e, np.arange(1, top + 2))
    for t in range(1, top + 1):
        k = slice(cut[t - 1], cut[t])
        if cut[t] > cut[t - 1]:
            own, first = np.unique(w[k], return_index=True)
            alpha[own, t] = np.add.reduceat(alpha[w[k], a[k]] * prob[p[k]], first)
    return alpha


def forward_long(vocab: Vocabulary, letters: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The log of the summed probability of all segmentations of one word of any length, in each language.

    Sums are carried from letter to letter: as many are held as the longest piece has letters, and scaled on the way.
    """
    slots = vocab.longest + 1
    alpha, log = np.zeros((slots, prob.shape[1])), np.zeros(prob.shape[1])
    alpha[0] = 1
    for a in range(0, len(letters), STRETCH):
        b = min(len(letters), a + STRETCH)
        part = letters[a : b + vocab.longest]
        _, start, end, piece = vocab.lattice(part, np.array([len(part)]))
        order = np.argsort(start, kind="stable")
        start, end, piece = start[order], end[order] + a, piece[order]
        cut = np.searchsorted(start, np.arange(b - a + 1))
        for k in range(b - a):
            own = slice(cut[k], cut[k + 1])
            now = alpha[(a + k) % slots].copy()
            alpha[(a + k) % slots] = 0
            alpha[end[own] % slots] += now * prob[piece[own]]  # a piece of each length at most
            if (a + k) % 16 == 15:
                most = np.maximum(alpha.max(axis=0), 1e-300)
                alpha /= most
                log += np.log(most)
    return log + np.log(np.maximum(alpha[len(letters) % slots], 1e-300))


def backward(edges, n_words: int, lens: np.ndarray, prob: np.ndarray) -> np.ndarray:
    w, a, e, p = edges
    order = np.lexsort((w, -a))
    w, a, e, p = w[order], a[order], e[order], p[order]
    top = int(e.max(initial=0))
    beta = np.zeros((n_words, top + 1, prob.shape[1]))
    beta[np.arange(n_words), lens] = 1
    cut = np.searchsorted(-a, np.arange(-top, 2))
    for k, t in enumerate(range(top, -1, -1)):
        s = slice(cut[k], cut[k + 1])
        if cut[k + 1] > cut[k]:
            own, first = np.unique(w[s], return_index=True)
            beta[own, t] += np.add.reduceat(beta[w[s], e[s]] * prob[p[s]], first)
    return beta


def estimate(counts: dict[str, dict[str, int]], name: str, rounds: int = ROUNDS, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities [piece, language] from word counts per language (in the dictionary's order)."""
    vocab = vocabulary(name)
    prob = np.zeros((len(vocab.pieces), len(counts)))
    for k, own in enumerate(counts.values()):
        words, n = list(own), np.array(list(own.values()), float)
        cp = np.concatenate([np.frombuffer(("▁" + w).encode("utf-32-le"), np.uint32) for w in words])
        lens = np.array([len(w) + 1 for w in words], np.int64)
        parts = np.array_split(np.arange(len(words)), max(1, len(words) // 8000))
        off = np.append(0, np.cumsum(lens))
        edges = [vocab.lattice(cp[off[i[0]] : off[i[-1] + 1]], lens[i]) for i in parts]
        # every piece that occurs anywhere, by how often
        first = sum(np.bincount(e[3], n[i][e[0]], minlength=len(prob)) for i, e in zip(parts, edges, strict=True))
        p = (first + smooth) / (first.sum() + smooth * len(prob))
        for _ in range(rounds):
            expected = np.zeros(len(prob))
            for i, e in zip(parts, edges, strict=True):
                al, be = forward(e, len(i), p[:, None])[:, :, 0], backward(e, len(i), lens[i], p[:, None])[:, :, 0]
                total = al[np.arange(len(i)), lens[i]]
                w, a, b, piece = e
                expected += np.bincount(piece, n[i][w] * al[w, a] * p[piece] * be[w, b] / total[w], minlength=len(prob))
            p = (expected + smooth) / (expected.sum() + smooth * len(prob))
        prob[:, k] = p
    return prob


def letter_runs(texts: list[str], longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends) of the runs of letters in lower-cased texts, cut to `longest` letters if it is given;
    and offsets."""
    cp, off = tv.codepoints([t.lower() for t in texts])
    letter = tv.classes()[cp] == tv.LETTER
    new = tv.run_starts(letter, off)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    keep = letter[starts] if len(starts) else np.empty(0, bool)
    starts, ends = starts[keep], ends[keep]
    if longest and len(starts) and int((ends - starts).max()) > longest:
        parts = -(-(ends - starts) // longest)
        begin = np.repeat(starts, parts) + tv.ragged(np.zeros(len(parts), np.int64), parts) * longest
        ends, starts = np.minimum(begin + longest, np.repeat(ends, parts)), begin
    return cp, starts, ends, off


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray
    tokenizer: str

    def __post_init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index, self.logp = tv.HashIndex(1 << 16), np.zeros((1 << 14, len(self.languages)))

    def word_scores(self, cp, starts, ends) -> np.ndarray:
        """Log probability of each word in each language."""
        if self.index.n > TABLE_WORDS:
            self.clear()
        keys = tv.word_hashes(cp, starts, ends)
        at = self.index.get(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            codes, uniq = pd.factorize(keys[new])
            first, n = new[tv.first_seen(codes, len(uniq))], self.index.n
            while n + len(uniq) > len(self.logp):
                self.logp = np.concatenate([self.logp, np.zeros_like(self.logp)])
            size, vocab = ends[first] - starts[first], vocabulary(self.tokenizer)
            for k in np.flatnonzero(size > LONGEST).tolist():
                letters = np.concatenate([np.array([_BEGIN], np.uint32), cp[starts[first[k]] : ends[first[k]]]])
                self.logp[n + k] = forward_long(vocab, letters, self.prob)
            short = np.flatnonzero(size <= LONGEST)
            for k in range(0, len(short), 4096):
                own = first[short[k : k + 4096]]
                lens = ends[own] - starts[own]
                letters = np.full(int((lens + 1).sum()), _BEGIN, np.uint32)
                body = np.ones(len(letters), bool)
                body[np.cumsum(lens + 1) - lens - 1] = False
                letters[body] = cp[tv.ragged(starts[own], lens)]
                alpha = forward(vocab.lattice(letters, lens + 1), len(own), self.prob)
                self.logp[n + short[k : k + 4096]] = np.log(np.maximum(alpha[np.arange(len(own)), lens + 1], 1e-300))
            self.index.add(uniq, np.arange(n, n + len(uniq)))
            at[new] = n + codes
        return self.logp[at]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, its probability among the languages) of every text."""
        names, score = [], np.zeros(len(texts))
        if not self.languages:
            return [UNDETERMINED] * len(texts), score
        for a, b in tv.blocks(texts):
            cp, starts, ends, off = letter_runs(texts[a:b])
            total = np.zeros((b - a, len(self.languages)))
            words = np.zeros(b - a, np.int64)
            if len(starts):
                edge = np.searchsorted(starts, off)
                words = np.diff(edge)
                run = np.zeros((len(starts) + 1, len(self.languages)))
                np.cumsum(self.word_scores(cp, starts, ends), axis=0, out=run[1:])
                total = run[edge[1:]] - run[edge[:-1]]
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            score[a:b] = np.where(words > 0, p, 0.0)
            names += [self.languages[k] if n else UNDETERMINED for k, n in zip(best.tolist(), words.tolist(), strict=True)]
        return names, score


def fit(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", texts: int = FIT_TEXTS, held_out: bool = True) -> Model:
    """A model of the languages in docs (doc_id, text, lang), from at most about `texts` texts a language.

    The sample of each language is drawn by a hash of doc_id, at a share that its count gives; all words of
    its texts count. The driver holds the words of one language at a time.
    Rows with null text, lang or id, and the held-out rows, are not learned from.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id is not null and lang is not null")
    if held_out:
        rows = rows.where(~common.held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Model([], np.zeros((1, 0)), tokenizer)
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, texts / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            texts_, langs = common.texts_of(b.column(0)), b.column(1).to_pylist()
            for i, j in tv.blocks(texts_):
                cp, starts, ends, off = letter_runs(texts_[i:j], LONGEST)
                whole = cp.tobytes().decode("utf-32-le")
                doc = np.searchsorted(off, starts, side="right") - 1
                seen.update((langs[i + d], whole[s:e]) for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True))
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    common.small_batches(docs.sparkSession)
    per_word = drawn.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    per_word = common.written(per_word, "words")
    found, columns = [], []
    for k in sorted(sizes):
        own = per_word.where(F.col("lang") == k).select("word", "n").toPandas().sort_values("word")
        if len(own):
            found.append(k)
            columns.append(estimate({k: dict(zip(own["word"], own["n"].tolist(), strict=True))}, tokenizer))
    return Model(found, np.hstack(columns) if found else np.zeros((1, 0)), tokenizer)


@functools.lru_cache(2)
def _loaded(frozen: bytes) -> Model:
    return Model(*pickle.loads(frozen))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every text.

    `und` with score 0 where the text is null or has no letter, or nothing was learned; ties go to the
    first language in alphabetical order; repeated rows and null ids stay; other columns are ignored.
    """
    frozen = pickle.dumps((model.languages, model.prob, model.tokenizer))

    def run(b):
        names, s = _loaded(frozen).predict(common.texts_of(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(s)], ["doc_id", "lang_pred", "score"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")
