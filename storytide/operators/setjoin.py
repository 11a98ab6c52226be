"""Joins of word sets by similarity, with an index of each set's rarest words.

Sets are (id, w): an id of its own each, w an array of distinct words. All words get one order, the rarest first. What a
similarity asks of two sets, a number c of shared words, then holds for prefixes: of two sets with c shared words
of k, the first k - c + 1 of either hold one. So only the rare words of a set are joined, and pairs that meet there are
compared exactly. Sets that are equal should come once (`distinct_sets`).

Where words are few for the sets, rare ones too have more sets the more sets there are, and most pairs that meet share
little else. So sets carry bits, one of BITS for each word (several words may have the same): what one set's bits
have and the other's lack are words that it does not share. That leaves out no pair, and pairs that it leaves are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaccard, overlap
from ..session import written

#: Bits of a set's words, 64 a column.
BITS = 512
_COLUMNS = BITS // 64


def distinct_sets(rows: DataFrame, key: str, words: str) -> tuple[DataFrame, DataFrame]:
    """(sets, members): id and w of every different set of words that is not empty, id its smallest key; key and id of every
    row. Both are read several times, so they are written."""
    named = written(rows.select(F.col(key), F.array_sort(words).alias("w")).where(F.size("w") > 0), "word-sets")
    sets = written(named.groupBy("w").agg(F.min(key).alias("id")).select("id", "w"), "word-sets")
    return sets, named.join(sets, "w").select(key, "id")


def _with_bits(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows with the bits of their sets."""
    at = sets.select("id", F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(BITS))).alias("at"))
    one = lambda k: F.aggregate("at", F.lit(0).cast("long"), lambda acc, x: F.when(F.floor(x / 64) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")))).otherwise(acc))
    return rows.join(at.select("id", F.array(*[one(k) for k in range(_COLUMNS)]).alias("bits")), "id")


def _lacks(a: str, b: str) -> Column:
    """How many bits of a's set b's lacks: so many words of a, at least, are not in b."""
    each = [F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(_COLUMNS)]
    return reduce(lambda x, y: x + y, each)


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    words = a.select(F.explode("w").alias("word")).unionAll(b.select(F.explode("w").alias("word")))
    return words.groupBy("word").agg(F.count("*").alias("df"))


def _placed(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """id, k, word, at: the words of each set with their places from 1, the rarest first."""
    rows = sets.select("id", F.size("w").alias("k"), F.explode("w").alias("word")).join(counts, "word")
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "word")))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns of either side named apart; they meet on a word."""
    return a.toDF("a", "word", "ka", "at_a", "bits_a"), b.toDF("b", "word", "kb", "at_b", "bits_b")


def _exact(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    return pairs.join(a.toDF("a", "wa"), "a").join(b.toDF("b", "wb"), "b")


def jaccard_candidates(a: DataFrame, b: DataFrame, least: float, one_way: bool = False) -> DataFrame:
    """a, b: the pairs of sets that may have a Jaccard similarity of `least`, by size, by a rare word, and by the words that
    are left behind it: two sets that share s words of ka and kb have s >= least / (1 + least) * (ka + kb).

    one_way: only pairs with a < b, for the join of sets with themselves."""
    extent = lambda d: d.agg(F.min(F.size("w")), F.max(F.size("w"))).first()
    (low_a, high_a), (low_b, high_b) = extent(a), extent(b)
    if low_a is None or low_b is None:
        return a.select(F.col("id").alias("a")).limit(0).join(b.select(F.col("id").alias("b")).limit(0))
    a, b = (d.where(F.size("w").between(least * low - 1e-9, high / least + 1e-9)) for d, low, high in ((a, low_b, high_b), (b, low_a, high_a)))
    counts = _counts(a, b)
    prefix = F.col("at") <= F.col("k") - F.ceil(F.col("k") * least - 1e-9) + 1
    x, y = _sides(*(_with_bits(_placed(d, counts).where(prefix), d).select("id", "word", "k", "at", "bits") for d in (a, b)))
    wanted = (F.col("ka") + F.col("kb")) * (least / (1 + least)) - 1e-9
    left = 1 + F.least(F.col("ka") - F.col("at_a"), F.col("kb") - F.col("at_b"))
    sizes = (F.col("ka") >= F.col("kb") * least - 1e-9) & (F.col("kb") >= F.col("ka") * least - 1e-9)
    alike = (F.col("ka") - _lacks("bits_a", "bits_b") >= wanted) & (F.col("kb") - _lacks("bits_b", "bits_a") >= wanted)
    met = x.join(y, "word").where(sizes & (left >= wanted) & alike)
    return (met.where(F.col("a") < F.col("b")) if one_way else met).select("a", "b").distinct()


def jaccard_pairs(a: DataFrame, b: DataFrame, least: float, one_way: bool = False) -> DataFrame:
    """a, b, similarity of all pairs of sets with a Jaccard similarity of at least `least` (above 0)."""
    x = _exact(jaccard_candidates(a, b, least, one_way), a, b).withColumn("similarity", jaccard(F.col("wa"), F.col("wb")))
    return x.where(F.col("similarity") >= least).select("a", "b", "similarity")


def overlap_candidates(a: DataFrame, b: DataFrame, least: float, shared: int) -> DataFrame:
    """a, b: the pairs of sets that may share `shared` words and `least` of the smaller set's words.

    Of the c words that the smaller set, of k, shares, two are among its k - c + 2 rarest; the larger set may have
    them anywhere.
    """
    a, b = (d.where(F.size("w") >= shared) for d in (a, b))
    counts = _counts(a, b)
    c = F.greatest(F.lit(shared), F.ceil(F.col("k") * least - 1e-9))
    few = min(2, shared)
    rows = lambda d: _placed(d, counts).select("id", "word", "k", F.when(F.col("at") <= F.col("k") - c + few, F.col("at")).alias("at"))
    x, y = _sides(*(_with_bits(rows(d), d) for d in (a, b)))
    wanted = F.greatest(F.lit(shared), F.ceil(F.least("ka", "kb") * least - 1e-9))
    alike = (F.col("ka") - _lacks("bits_a", "bits_b") >= wanted) & (F.col("kb") - _lacks("bits_b", "bits_a") >= wanted)
    in_prefix = F.when(F.col("ka") <= F.col("kb"), F.col("at_a")).otherwise(F.col("at_b")).isNotNull()
    return x.join(y, "word").where(in_prefix & alike).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= few).select("a", "b")


def overlap_pairs(a: DataFrame, b: DataFrame, least: float, shared: int = 3) -> DataFrame:
    """a, b of all pairs of sets that share `shared` words and `least` of the smaller set's words."""
    return _exact(overlap_candidates(a, b, least, shared), a, b).where(overlap(F.col("wa"), F.col("wb"), shared) >= least).select("a", "b")
