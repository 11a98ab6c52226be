"""Quality classification by importance resampling.

A document is a bag of hashed n-grams: words, pairs of words, and triples of
word shapes. Two generative models over the buckets, one of the target (texts
labelled good, a bounded sample) and one of the raw corpus (all texts), give the
log importance weight of a document, the sum of its n-grams' log ratios. Sums
over hundreds of n-grams that depend on each other are far too sure: they are
tempered to what SHARP n-grams would say, and drawn towards 0 for short texts.
Adding Gumbel noise and keeping the k largest keys samples k documents without
replacement in proportion to their tempered weights; the noise is a hash of the
row, so every run draws the same.
"""

from __future__ import annotations

import functools
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import common, sampling
from . import textvec as tv

BUCKETS = 16_384
#: The labelled rows that the target model and the share of good documents are fitted on, at most.
FIT_ROWS = 20_000
#: The share of good labelled documents that the choice of k has to leave in.
KEEP_GOOD = 0.998
#: N-grams that a document's weight counts for, and those that stand for the raw corpus in every document.
SHARP, PRIOR = 128, 32
#: Bits of a sampling key that one counting pass fixes.
DIGIT = 16


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, index of its text), for a block of texts."""
    cp, off = tv.codepoints(texts)
    cls = tv.classes()[cp]
    new = tv.run_starts(cls, off)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    keep = cls[starts] != tv.SPACE if len(starts) else np.empty(0, bool)
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = tv.word_hashes(cp, starts, ends)
    doc = np.searchsorted(off, starts, side="right") - 1
    # shape: class, capital first, capital last, length class; other signs keep their first character
    up = (cp >= 65) & (cp <= 90)
    length = np.minimum(ends - starts, 4).astype(np.uint64)
    shape = cls[starts].astype(np.uint64) * np.uint64(64) + up[starts] * np.uint64(32) + up[ends - 1] * np.uint64(16) + length
    shape = np.where(cls[starts] == tv.OTHER, cp[starts].astype(np.uint64) * np.uint64(8) + length + np.uint64(1 << 32), shape)
    pair = tv.mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) > 1 else word[:0]
    triple = tv.mix((shape[:-2] * np.uint64(0x9E3779B97F4A7C15) + shape[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + shape[2:]) if len(word) > 2 else word[:0]
    same2, same3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    h = np.concatenate([word, pair[same2], triple[same3]])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][same2], doc[2:][same3]])


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed bucket models."""
    n = len(raw)
    return np.log((target + smooth) / (target.sum() + smooth * n)) - np.log((raw + smooth) / (raw.sum() + smooth * n))


def weigh(texts: list[str], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log importance weight, n-grams) of every text."""
    out, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for a, b in tv.blocks(texts):
        g, d = grams(texts[a:b], len(ratio))
        out[a:b] = np.bincount(d, ratio[g], minlength=b - a)
        n[a:b] = np.bincount(d, minlength=b - a)
    return out, n


def temper(log_weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The tempered log weights of documents of n n-grams."""
    return SHARP * log_weight / (n + PRIOR)


def gumbel(ids: list[int | None], texts: list[str], seed: int) -> np.ndarray:
    """Gumbel noise from a hash of each row's id and text."""
    import xxhash

    u = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed=(seed + hash(i)) & 0xFFFFFFFFFFFFFFFF) if i is not None else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed=seed) for i, t in zip(ids, texts, strict=True)], np.uint64)
    x = (u >> np.uint64(11)).astype(np.float64) / 2.0**53
    return -np.log(-np.log(np.clip(x, 1e-300, 1 - 1e-16)))


@dataclass
class Model:
    """The buckets' log ratios, and the tempered weight from which a document counts towards k."""

    ratio: np.ndarray
    threshold: float
    seed: int = 7


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of docs; one row per bucket reaches the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = common.texts_of(b.column(0))
            for i, j in tv.blocks(texts):
                total += np.bincount(grams(texts[i:j], buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(total[at])], ["bucket", "n"])

    common.small_batches(docs.sparkSession)
    out = np.zeros(buckets)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def threshold(good: np.ndarray, bad: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """The weight that parts good from bad best, no higher than leaves `keep` of the good ones above it."""
    if not len(good):
        return -np.inf
    top = np.quantile(good, 1 - keep, method="lower")
    if not len(bad):
        return float(top)
    cuts = np.unique(np.append(np.concatenate([good, bad]), top))
    cuts = cuts[cuts <= top]
    g, b = np.sort(good), np.sort(bad)
    right = (len(g) - np.searchsorted(g, cuts)) / len(g) + np.searchsorted(b, cuts) / len(b)
    best = cuts[np.argmax(right)]
    lower = b[b < best]  # halfway to the next bad one
    return float((best + lower[-1]) / 2 if len(lower) else best)


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """The model of the documents `docs`: raw counts over all of them, the target from at most `rows`
    rows of labels (doc_id, quality) with quality 1, whose texts are looked up in `corpus` (docs by default).
    Without good labelled texts every document counts as good; ids whose labels differ are not learned from."""
    keys = sampling.smallest(sampling.agreed(labels, "quality"), rows, "doc_id")
    sample = common.written(sampling.texts_with(docs if corpus is None else corpus, keys, "doc_id", "quality"), "quality-sample")
    target, raw = counts(sample.where("value = '1'"), buckets), counts(docs, buckets)
    if not target.sum():
        return Model(np.zeros(buckets), -np.inf)
    ratio = log_ratio(target, raw)

    def measure(b):
        w, n = weigh(common.texts_of(b.column(1)), ratio)
        return pa.RecordBatch.from_arrays([pa.array(temper(w, n)), pa.array([v == "1" for v in b.column(2).to_pylist()])], ["w", "good"])

    got = common.map_arrow(sample, measure, "w double, good boolean").toPandas()
    good = got["good"].to_numpy(bool)
    w = got["w"].to_numpy()
    return Model(ratio, threshold(w[good], w[~good]))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles."""
    i = x.view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _keyed(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """docs with the columns log_weight, n_grams, weight (tempered), key (weight with noise), rank_key (its order
    as a long) and row (a number of the row), under the given names; written, so that numbers stay."""
    frozen, text_at, id_at = pickle.dumps(model), docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        m, row = _loaded(frozen), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = common.texts_of(b.column(text_at))
            w, n = weigh(texts, m.ratio)
            weight = temper(w, n)
            key = weight + gumbel(b.column(id_at).to_pylist(), texts, m.seed)
            own = [pa.array(x) for x in (w, n, weight, key, _sortable(key), np.arange(row, row + len(texts)))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, *names])

    common.small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *(StructField(n, t()) for n, t in zip(names, (DoubleType, LongType, DoubleType, DoubleType, LongType, LongType), strict=True))])
    return docs.mapInArrow(run, schema)


MADE = ["log_weight", "n_grams", "weight", "key", "rank_key", "row"]


@functools.lru_cache(2)
def _loaded(frozen: bytes) -> Model:
    return pickle.loads(frozen)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: four counting passes, each of which fixes 16 bits."""
    if k <= 0:
        return None
    low, left = -(2**63), k
    for shift in range(64 - DIGIT, -1, -DIGIT):
        span = F.col(column).between(low, low + (1 << (shift + DIGIT)) - 1) if shift + DIGIT < 64 else F.lit(True)
        # the digit of a key within the span, as an unsigned number
        digit = F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(2**63))), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        rows = sorted(((r["d"], r["n"]) for r in keys.where(span).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in rows:  # 65 536 rows at most
            if n >= left:
                low += d << shift
                break
            left -= n
        else:
            return None
    return low


def _chosen(keyed: DataFrame, names: list[str], k: int):
    """Whether a row is among the k of the largest keys; of rows with the key at the border, the first ones by number."""
    rank, row = names[4], names[5]
    cut = kth_largest(keyed, rank, k)
    if k <= 0 or cut is None:
        return F.lit(k > 0)
    above = keyed.where(F.col(rank) > cut).count()
    last = kth_largest(keyed.where(F.col(rank) == cut).select((-F.col(row)).alias(row)), row, k - above)
    return (F.col(rank) > cut) | ((F.col(rank) == cut) & (F.col(row) <= -last))


def _size(keyed: DataFrame, names: list[str], model: Model) -> int:
    """The default k: the documents whose tempered weight reaches the model's threshold."""
    return keyed.where(F.col(names[2]) >= float(model.threshold)).count()


def resample(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, weight, key, selected of every document: k of them are selected by Gumbel top-k.

    k is by default the number of documents whose tempered weight reaches the model's threshold; all rows if
    there are fewer than k. Copies of a row (equal id and text) have the same key, and where it is the last to be
    selected, only as many of them are as make k. Null text is empty and weighs 0; null ids and repeated rows
    stay; an empty table gives no rows.
    """
    keyed = common.written(_keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, MADE).drop("text"), "importance")
    chosen = _chosen(keyed, MADE, _size(keyed, MADE, model) if k is None else k)
    return keyed.select("doc_id", "log_weight", "n_grams", "weight", "key", chosen.alias("selected"))


def keep_selected(docs: DataFrame, model: Model, k: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that resampling selects (see `resample`)."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    names = [mark + n for n in MADE]
    keyed = common.written(_keyed(docs, model, names), "importance")
    return keyed.where(_chosen(keyed, names, _size(keyed, names, model) if k is None else k)).select(*docs.columns)
