"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other scripts, digits and
signs that stand for letters inside words) and cut into words joined by single
blanks. The lexicon holds whole words and beginnings of words, each with the
log-odds by which it marks toxic texts, and exception phrases, which cancel what
they cover. One Aho-Corasick automaton finds all of them in one pass. The summed
weight, also divided by the length, goes through a logistic function.

The lexicon, the exceptions and the function are learned from a bounded sample
of labelled rows; scoring covers every text whole.
"""

from __future__ import annotations

import functools
import math
import pickle
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling
from . import textvec as tv

#: The labelled rows that a model is fitted on, at most.
FIT_ROWS = 20_000
#: Entries of a lexicon, at most, the best first.
LEXICON = 4_000
#: Letters of other scripts that look like Latin ones, fixed values.
LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝαοιυνκρτεβмнвкт", "aeopcyxijshdqwaoiuvkptebmhbkt")
#: Digits and signs that stand for letters inside words, fixed values.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases around lexicon words that are no insult; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "stupid simple")


@functools.cache
def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point, sign's letter or 0) per code point."""
    cls = tv.classes()
    out = np.arange(len(cls), dtype=np.uint32)
    for c in np.flatnonzero(cls == tv.LETTER).tolist():
        if c < 0x250 or 0x370 <= c < 0x530 or 0x1E00 <= c < 0x2000 or 0xFF00 <= c < 0xFFF0 or 0x1D400 <= c < 0x1D800:
            ch = unicodedata.normalize("NFKD", chr(c))[:1].lower()[:1].translate(LOOKALIKES)
            if ch:
                out[c] = ord(ch)
    for ch, to in (("ß", "s"), ("æ", "a"), ("œ", "o"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i")):
        out[[ord(ch), ord(ch.upper()[0])]] = ord(to)
    out[ord("S")], out[ord("I")] = ord("s"), ord("i")
    signs = np.zeros(len(cls), np.uint32)
    for s, to in SIGNS.items():
        signs[ord(s)] = ord(to)
    return out, signs


def fold(texts: list[str]) -> tuple[str, np.ndarray]:
    """(all texts folded, words between single blanks and a blank at either end; n + 1 offsets of the texts)

    Zero-width and combining characters vanish. A digit or sign becomes a letter between letters (others
    of its kind may lie in between), or where it begins a word of letters; numbers, closing marks and
    marks before a word stay what they are.
    """
    texts = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts]
    cp, off = tv.codepoints(texts)
    letters, signs = _fold_table()
    cls = tv.classes()[cp]
    gone = np.zeros(len(cp), bool)
    if not all(map(str.isascii, texts)):
        gone = np.isin(cp, [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]) | ((cp >= 0x300) & (cp < 0x370))
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    cp, cls, doc = cp[~gone], cls[~gone], doc[~gone]
    n = len(cp)
    sign = signs[cp]
    is_letter = cls == tv.LETTER
    part = is_letter | (sign > 0)
    at = np.arange(n)
    # the nearest letter before and behind, with nothing but signs between
    stop = np.maximum.accumulate(np.where(~part, at, -1)) if n else at
    before = np.maximum.accumulate(np.where(is_letter, at, -1)) if n else at
    stop_r = np.minimum.accumulate(np.where(~part, at, n)[::-1])[::-1] if n else at
    behind = np.minimum.accumulate(np.where(is_letter, at, n)[::-1])[::-1] if n else at
    inside = (sign > 0) & ~is_letter & (before > stop) & (behind < stop_r) & (before >= 0) & (behind < n)
    if n:
        inside &= (doc[np.maximum(before, 0)] == doc) & (doc[np.minimum(behind, n - 1)] == doc)
    if n:
        mark = (cp == 33) | (cp == 124)
        begins = (sign > 0) & ~is_letter & ~mark & (before <= stop) & (behind < stop_r) & (behind < n)
        begins &= (doc[np.minimum(behind, n - 1)] == doc) & ~((stop >= 0) & (cls[np.maximum(stop, 0)] == tv.NUMBER) & (doc[np.maximum(stop, 0)] == doc))
        inside |= begins
    cp = np.where(inside, sign, letters[cp])
    word = is_letter | inside | (cls == tv.NUMBER)
    # a blank before each text and after it, one between words
    new = np.zeros(n, bool)
    if n:
        new[1:] = (doc[1:] != doc[:-1]) | ~word[:-1]
        new[0] = True
    new &= word
    counts = np.bincount(doc[word], minlength=len(texts)) + np.bincount(doc[new], minlength=len(texts)) + 1
    out_off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=out_off[1:])
    out = np.full(int(out_off[-1]), 32, np.uint32)
    kept = np.flatnonzero(word)
    out[np.arange(len(kept)) + np.cumsum(new[kept]) + doc[kept]] = cp[kept]
    return out.tobytes().decode("utf-32-le"), out_off


@dataclass
class Model:
    """weight of each pattern (in blanks: ' word ' whole, ' begin' a beginning), exceptions, and the logistic function's four numbers."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float, float] = (-2.0, 0.0, 0.0, 0.0)

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: 1, log(1 + weight), weight per 100 words, log(1 + places)."""
        whole, off = fold(texts)
        weight, places = np.zeros(len(texts)), np.zeros(len(texts))
        if len(self.automaton):
            hits = [(end, *v) for end, v in self.automaton.iter(whole)]
            if hits:
                end = np.array([h[0] for h in hits], np.int64)
                size = np.array([h[1] for h in hits], np.int64)
                value = np.array([np.nan if h[2] is None else h[2] for h in hits])
                start, cover = end - size + 1, np.isnan(value)
                keep = ~cover
                if cover.any():  # a pattern inside an exception phrase doesn't count
                    s, e = start[cover], end[cover]
                    order = np.argsort(s)
                    reach = np.maximum.accumulate(e[order])
                    k = np.searchsorted(s[order], start, side="right") - 1
                    keep &= ~((k >= 0) & (reach[np.maximum(k, 0)] >= end))
                doc = np.searchsorted(off, start[keep], side="right") - 1
                # a place counts once, by its strongest pattern
                order = np.lexsort((-value[keep], start[keep]))
                first = np.unique(start[keep][order], return_index=True)[1]
                chosen = order[first]
                weight = np.bincount(doc[chosen], value[keep][chosen], minlength=len(texts))
                places = np.bincount(doc[chosen], minlength=len(texts)).astype(float)
        blanks = np.frombuffer(whole.encode("utf-32-le"), np.uint32) == 32
        words = np.add.reduceat(blanks, off[:-1]) - 1 if len(texts) else np.zeros(0)
        return np.stack([np.ones(len(texts)), np.log1p(weight), np.minimum(30, weight / np.maximum(1, words) * 100), np.log1p(places)], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-np.clip(self.features(texts[a:b]) @ np.array(self.curve), -40, 40))) for a, b in tv.blocks(texts)] or [np.empty(0)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _odds(t, c, n_toxic: int, n_clean: int):
    """Log-odds column of t toxic and c clean texts."""
    return F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))


def lexicon(words: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON) -> tuple[dict[str, float], list[str]]:
    """Patterns and exceptions from words: word, toxic, clean (texts of either kind with it).

    A beginning that many different toxic words share is one pattern; of a word that stands alone, the
    whole word. A word that begins like a pattern but comes mostly in clean texts is an exception.
    What one text in a hundred of the toxic ones doesn't have is left out: rare words say little.
    Only patterns and exceptions, at most `size` of either, reach the driver.
    """
    least, threshold = max(4, math.ceil(0.01 * n_toxic)), math.log(20)
    longer = (F.col("toxic") > 0) & (F.length("word") > F.col("k"))
    begins = words.where(F.length("word") >= 4).withColumn("k", F.explode(F.sequence(F.lit(4), F.least(F.lit(8), F.length("word")))))
    begins = begins.groupBy(F.expr("substring(word, 1, k)").alias("begin")).agg(F.sum(F.when(longer, F.col("toxic")).otherwise(0)).alias("t"), F.count_if(longer).alias("n"), F.max(F.when(longer, F.col("toxic")).otherwise(0)).alias("most"), F.sum("clean").alias("c"))
    begins = begins.withColumn("odds", _odds(F.col("t"), F.col("c"), n_toxic, n_clean))
    shared = begins.where((F.col("n") >= 6) & (F.col("most") <= 0.3 * F.col("t")) & (F.col("t") >= max(20, 2 * least)) & (F.col("c") <= 0.01 * F.col("t")) & (F.col("odds") >= threshold))
    weights: dict[str, float] = {}
    for r in sorted(shared.orderBy(F.desc("odds"), "begin").limit(size).collect(), key=lambda r: (len(r["begin"]), r["begin"])):
        if not any(f" {r['begin'][:k]}" in weights for k in range(4, len(r["begin"]))):
            weights[f" {r['begin']}"] = r["odds"]
    covered = F.lit(False)
    for k in range(4, 9):
        own = [p[1:] for p in weights if len(p) == k + 1]
        if own:
            covered = covered | F.substring("word", 1, k).isin(own)
    odds = _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    alone = words.where(~covered & (F.col("toxic") >= least)).withColumn("odds", odds).where(F.col("odds") >= threshold)
    weights |= {f" {r['word']} ": r["odds"] for r in alone.orderBy(F.desc("odds"), "word").limit(size).collect()}
    mostly_clean = words.where(covered & (F.col("clean") >= 2) & (odds < 0))
    exceptions = [r["word"] for r in mostly_clean.orderBy(F.desc("clean"), "word").limit(size).collect()]
    best = sorted(weights, key=lambda p: (-weights[p], p))[:size]
    return {p: weights[p] for p in best}, sorted(exceptions)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, held_out: bool = True) -> Model:
    """A model from at most `rows` labelled rows: of `labels` (doc_id, toxic) those not held out, by hash.

    Rows with null labels or ids and ids whose labels differ don't count. Without labels of both kinds the model finds nothing.
    """
    use = sampling.agreed(labels, "toxic")
    if held_out:
        use = use.where(~common.held_out(F.col("doc_id")))
    sample = common.written(sampling.texts_with(docs, sampling.smallest(use, rows, "doc_id"), "doc_id", "toxic"), "toxicity-sample")

    def count(batches):
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        n = Counter()
        for b in batches:
            whole, off = fold(common.texts_of(b.column(1)))
            for k, v in enumerate(b.column(2).to_pylist()):
                seen[v == "1"].update({w for w in whole[off[k] : off[k + 1]].split() if 3 <= len(w) <= 40})
                n[v == "1"] += 1
        words = [*(seen[True] | seen[False]), ""]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[True][w] if w else n[True] for w in words], pa.int64()), pa.array([seen[False][w] if w else n[False] for w in words], pa.int64())], ["word", "toxic", "clean"])

    per_word = common.written(sample.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    totals = per_word.where("word = ''").collect()
    n_toxic, n_clean = (totals[0]["toxic"] or 0, totals[0]["clean"] or 0) if totals else (0, 0)
    if not n_toxic or not n_clean:
        return Model({})
    weights, learned = lexicon(per_word.where("word != ''"), n_toxic, n_clean)
    model = Model(weights, sorted({*exceptions, *learned}))
    frozen = pickle.dumps((model.weights, model.exceptions))

    def measure(b):
        m = _loaded(frozen)
        texts = common.texts_of(b.column(1))
        x = np.concatenate([m.features(texts[i:j]) for i, j in tv.blocks(texts)])
        return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(1, 4)] + [pa.array([v == "1" for v in b.column(2).to_pylist()])], ["a", "b", "c", "y"])

    rows_ = common.map_arrow(sample, measure, "a double, b double, c double, y boolean").toPandas()
    x = np.column_stack([np.ones(len(rows_)), rows_[["a", "b", "c"]].to_numpy()])
    model.curve = tuple(logistic(x, rows_["y"].to_numpy(float)).tolist())
    return model


@functools.lru_cache(2)
def _loaded(frozen: bytes) -> Model:
    return Model(*pickle.loads(frozen))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every text. Null text is empty; repeated rows stay; other columns are ignored."""
    frozen = pickle.dumps((model.weights, model.exceptions, model.curve))

    def run(b):
        s = _loaded(frozen).score(common.texts_of(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"))], ["doc_id", "score", "predicted"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5."""
    frozen = pickle.dumps((model.weights, model.exceptions, model.curve))
    at = docs.columns.index(column)

    def run(b):
        return b.filter(pa.array(_loaded(frozen).score(common.texts_of(b.column(at))) < 0.5))

    return common.map_arrow(docs, run, docs.schema)
