"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give a share of the mix's words, so each of its documents is to be copied r = target / size of the
source times: floor(r) copies for certain, and one more with probability p = r - floor(r). Pairs then settle these probabilities: words are
moved from the one side to the other, in a direction drawn so that neither probability changes on average, until one of
the two is 0 or 1; the other goes on to the next pair. What a pair takes in words stays the same, so a source misses
its target only by the one document that is left over in the end.

The pairs form a tree. A source's documents are dealt to leaves by a hash, and each leaf settles all of its documents but
one: by descending size, a document is paired with the rest of its leaf, whose documents have one probability in
common and take or give the words alike, so that a long document is made up for by all shorter ones, and the shortest
is left over, unless all shorter ones together can't make up for one. Of the documents that
are left over 64 leaves make one leaf of the next level, whose documents are paired one by one, until a source has one
leaf. Leaves, order and draws follow from the rows alone, so that reruns agree however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running_sums
from . import common

WEIGHTS, CEILING = (1, 2, 3), 3
#: Documents of a leaf on average, and leaves that make one leaf of the next level.
LEAF, FAN = 4096, 64
#: White space between words, fixed values.
WHITE = " \t\n\x0b\x0c\r"
_GOLDEN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_in(text: Column) -> Column:
    """The number of runs of characters other than blanks and U+0009 to U+000D; null has none."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tag: the words of each document and a hash of its id and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(text).alias("size"), _tag())


def _tag() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tag")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """source, n, source_size, target of every source of (source, size).

    Sources in the order of their code points, null last, get the weights in turn. Targets share the sum of all sizes
    by weight, but none exceeds `ceiling` times its source; what is cut off goes to the others by weight, until none
    is above. So targets are min(ceiling * size, level * weight): sources by size per weight are cut off one after
    the other, and the level is found where the first is not.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = running_sums(per, [], [F.col("source").asc_nulls_last()], {"turn": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    most = (F.col("source_size") * ceiling).alias("most")
    made = common.written(turn.withColumns({"weight": weight, "most": most}), "mix-sources")
    all_of = made.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weighs = all_of[0] or 0, all_of[1] or 0.0
    cut = running_sums(made, [], [F.col("most") / F.col("weight"), F.col("turn")], {"cut": F.col("most"), "past": F.col("weight")})
    level = (F.lit(total) - (F.col("cut") - F.col("most"))) / (F.lit(weighs) - (F.col("past") - F.col("weight")))
    open_ = cut.withColumn("level", level.cast("double")).where(F.col("most") >= F.col("level") * F.col("weight"))
    first = open_.agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("turn")))).first()[0]
    share = F.lit(float("inf") if first is None else first) * F.col("weight")
    return made.select("source", "n", "source_size", F.least(F.col("most").cast("double"), share).alias("target"))


def _with_targets(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """The documents with their source's row. Sources of a hundredth of all documents or more, at most 100, are
    broadcast; the others, none of which is large, are joined by key."""
    n = sizes.count()
    aims = common.written(aims.withColumnRenamed("source", "of"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    large = F.broadcast(aims.where(F.col("n") * 100 >= n))
    rest = sizes.join(large.select("of"), same, "left_anti").join(aims.where(F.col("n") * 100 < n), same)
    return sizes.join(large, same).unionByName(rest).drop("of")


def _draw(a: int, b: int, k: int) -> float:
    """A number in [0, 1) by a 64-bit finaliser of two tags and the pair's number."""
    h = (a * 3 + (b ^ (b >> 7)) + k * _GOLDEN) & _MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return ((h ^ (h >> 32)) >> 11) / (1 << 53)


def pair(size_a: int, p_a: float, size_b: int, p_b: float, u: float) -> tuple[float, float]:
    """The probabilities of two documents after words were moved between them; one at least is 0 or 1.

    u: uniform in [0, 1). p_a * size_a + p_b * size_b stays, and so does each probability on average.
    """
    room_a, room_b, has_a, has_b = size_a * (1 - p_a), size_b * (1 - p_b), size_a * p_a, size_b * p_b
    to_a, to_b = min(room_a, has_b), min(has_a, room_b)
    if u * (to_a + to_b) < to_b:
        a, b = (1.0, p_b - to_a / size_b) if room_a <= has_b else (p_a + to_a / size_a, 0.0)
        return (a, 0.0) if room_a == has_b else (a, b)
    a, b = (0.0, p_b + to_b / size_b) if has_a <= room_b else (p_a - to_b / size_a, 1.0)
    return (a, 1.0) if has_a == room_b else (a, b)


ROW = "doc_id long, source string, tag long, size long, source_size long, target double, leaf long, leaves long, copies long, p double"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def _sorted(rows: DataFrame, *more: str) -> DataFrame:
    return rows.sortWithinPartitions("source", "leaf", F.desc("size"), "tag", "doc_id").select(*COLUMNS, *more)


def _settle_leaves(rows: DataFrame) -> DataFrame:
    """The rows, all but one of each leaf with p 0, from rows whose p is the same within a source: one pass along each sorted
    leaf, which holds the words and the probability of the rest and a single open row."""

    def run(batches):
        leaf, open_, p, rest, k = None, None, 0.0, 0, 0
        for b in batches:
            out = []
            for row in zip(*[b.column(i).to_pylist() for i in range(len(COLUMNS) + 1)], strict=True):
                row, words = list(row[:-1]), row[-1]
                if (row[1], row[6]) != leaf:
                    if open_:
                        out.append(open_)
                    leaf, open_, p, rest, k = (row[1], row[6]), None, row[9], words, 0
                k, rest = k + 1, rest - row[3]
                own = p
                if rest > 0 and 0.0 < p < 1.0:
                    own, p = pair(row[3], p, rest, p, _draw(row[2], k, k))
                    own, p = (0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x for x in (own, p))
                row[8] += own == 1.0
                row[9] = own if 0.0 < own < 1.0 else 0.0
                if row[9]:
                    open_ = row
                else:
                    out.append(row)
            yield _batch(out)
        if open_:
            yield _batch([open_])

    dealt = rows.repartition("source", "leaf").withColumn("words", F.sum("size").over(Window.partitionBy("source", "leaf")))
    return _sorted(dealt, "words").mapInArrow(run, ROW)


def _settle(rows: DataFrame) -> DataFrame:
    """The rows, all but one of each leaf with p 0: one pass along each sorted leaf, which holds a single open row."""

    def run(batches):
        leaf, open_, k = None, None, 0
        for b in batches:
            out = []
            for row in zip(*[b.column(i).to_pylist() for i in range(len(COLUMNS))], strict=True):
                row = list(row)
                if (row[1], row[6]) != leaf:
                    if open_:
                        out.append(open_)
                    leaf, open_, k = (row[1], row[6]), row, 0
                    continue
                if open_ is None:
                    open_ = row
                    continue
                k += 1
                two = (open_, row)
                for x, p in zip(two, pair(open_[3], open_[9], row[3], row[9], _draw(open_[2], row[2], k)), strict=True):
                    x[9] = 0.0 if p < 1e-12 or p > 1 - 1e-12 else p
                    x[8] += p > 1 - 1e-12
                open_ = None
                for x in two:
                    if x[9]:
                        open_ = x
                    else:
                        out.append(x)
            yield _batch(out)
        if open_:
            yield _batch([open_])

    return _sorted(rows.repartition("source", "leaf")).mapInArrow(run, ROW)


def _batch(rows: list[list]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [c.split() for c in ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [c for c, _ in fields])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: int = CEILING, leaf: int = LEAF) -> DataFrame:
    """doc_id, source, tag, size, source_size, target, copies of every document: how often the mix takes it.

    docs: doc_id, text, source; other columns are ignored. A null text has size 0, a null source is a source, which
    comes last; documents of size 0 get their sure copies. Repeated rows are documents of their own, each with its
    copies; a null doc_id stays null. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    sizes = common.written(measured(docs), "mix-sizes")
    aimed = _with_targets(sizes, targets(sizes, weights, ceiling))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaves = F.ceil(F.col("n") / leaf)
    aimed = aimed.withColumns({"copies": F.floor(times).cast("long"), "p": F.when(F.col("size") > 0, times - F.floor(times)).otherwise(F.lit(0.0)), "leaves": leaves, "leaf": F.pmod("tag", leaves)})
    now = common.written(aimed.select(*COLUMNS), "mix-aimed")
    most = now.agg(F.max("leaves")).first()[0] or 0
    done, now, settle = now.where("p = 0"), now.where("p > 0"), _settle_leaves
    while most:
        settled = common.written(settle(now), "mix-settled")
        done, now = done.unionByName(settled.where("p = 0")), settled.where("p > 0")
        if most == 1:
            break
        settle = _settle
        now = now.withColumns({"leaf": F.floor(F.col("leaf") / FAN), "leaves": F.ceil(F.col("leaves") / FAN)})
        most = -(-most // FAN)
    u = F.pmod(F.xxhash64("tag", F.lit("last")), F.lit(1 << 53)) / (1 << 53)
    last = now.withColumn("copies", F.col("copies") + (u < F.col("p")).cast("long"))  # one document a source at most
    return done.unionByName(last).select("doc_id", "source", "tag", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs as often as `mixed` (of mix) takes them, with `copy` from 1.

    Rows alike in doc_id, source and text are numbered through."""
    key = {"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__tag": _tag()}
    takes = mixed.groupBy("doc_id", "source", "tag").agg(F.sum("copies").alias("__copies")).where("__copies > 0")
    takes = takes.select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("tag").alias("__t"), "__copies")
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__tag") == F.col("__t"))
    once = docs.withColumns(key).dropDuplicates(list(key))
    return once.join(takes, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of every document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
