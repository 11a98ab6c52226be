"""Spelling variant grouping: a self-join of the vocabulary at distance one by tries with active-node sets.

Two words are near if they differ by one inserted, deleted or replaced letter. Near words of lengths c and c or c + 1 make
class c, and they first differ at one place, from 0 to c. Each class is joined by windows of places [lo, hi): near words
that first differ there share their first lo letters and what follows the window, so a window's words are partitioned by
this prefix and rest, and each partition plants a trie of what lies between. There, active nodes (those at distance one
at most from the node at hand) are propagated downwards, and pairs of ends at distance one come out. A pair has one class
and one place, so it comes out of one partition, once in either direction.

Windows begin as halves of the word. A partition of more than `ROOM` words halves its window again, until it has room:
a window of one place has at most 90 * 90 + 90 words over the alphabet of the runs, whatever the size of the corpus.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The letters of a run, fixed values: A-Z, a-z and U+00C0 to U+00FF; 90 letters once A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_SEEN, RATIO = 6, 5, 5
#: Words of a partition, at most; a window of one place never has more.
ROOM = 90 * 90 + 90
KEY = ("c", "lo", "hi", "pre", "rest")


def runs(docs: DataFrame, letters: int = LEAST_LETTERS) -> DataFrame:
    """doc_id, run: the maximal runs of at least `letters` letters of whole texts, A-Z lower-cased, one row each."""
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{letters},}}"), 0)
    return docs.select(F.col("doc_id"), F.explode(found).alias("run"))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """The runs with slips: where `every` divides h = crc32 of `<doc_id>:<run>`, the letter h % length is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    return found.select("doc_id", F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, letters: int = LEAST_LETTERS, seen: int = LEAST_SEEN) -> DataFrame:
    """word, n: the distinct runs of at least `letters` letters that occur at least `seen` times."""
    return found.where(F.length("run") >= letters).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def _keyed(rows: DataFrame) -> DataFrame:
    """The prefix and the rest that a window's near words share."""
    rest = F.greatest(F.col("c") - F.col("hi"), F.lit(0))
    return rows.withColumns({"pre": F.substr("word", F.lit(1), F.col("lo")), "rest": F.substr("word", F.length("word") - rest + 1)})


def _halved(rows: DataFrame, mid) -> DataFrame:
    halves = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return _keyed(rows.select("word", "n", "c", F.explode(halves).alias("w")).select("word", "n", "c", "w.lo", "w.hi"))


def partitions(words: DataFrame, room: int = ROOM) -> DataFrame:
    """word, n, c, lo, hi, pre, rest: every word in the partitions of its classes and windows, each with room."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("c")).where(F.col("c") > 0)
    rows = _halved(rows.withColumns({"lo": F.lit(0), "hi": F.col("c") + 1}), F.expr("c DIV 2").cast("int"))
    done = None
    while True:
        rows = common.written(rows, "spelling-windows")
        large = common.written(rows.groupBy(*KEY).count().where((F.col("count") > room) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, list(KEY), "left_anti").select(*rows.columns)
        done = fits if done is None else done.unionByName(fits)
        rows = _halved(rows.join(large, list(KEY), "left_semi"), F.expr("(lo + hi) DIV 2").cast("int"))


def active_pairs(words: list[str]):
    """(x, y): the places of all words at distance one, in both directions, by active-node sets in a trie of them."""
    kids, ends = [{}], [-1]
    for k, word in enumerate(words):
        at = 0
        for c in word:
            to = kids[at].get(c)
            if to is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = to
        ends[at] = k
    todo = [(0, list(kids[0].values()))]  # a node and the nodes at distance one from it; at distance none is itself alone
    while todo:
        at, near = todo.pop()
        if ends[at] >= 0:
            for v in near:
                if ends[v] >= 0:
                    yield ends[at], ends[v]
        for c, to in kids[at].items():
            beside = {at}  # c left out
            beside.update(kids[at].values())  # c replaced
            beside.update(kids[to].values())  # a letter added behind c
            beside.update(kids[v][c] for v in near if c in kids[v])  # c kept
            beside.discard(to)
            todo.append((to, beside))


def _first_difference(x: str, y: str) -> int:
    at = 0
    for a, b in zip(x, y, strict=False):
        if a != b:
            break
        at += 1
    return at


def near_pairs(words: DataFrame, room: int = ROOM) -> DataFrame:
    """word, near, near_n: all pairs of near words, in both directions. words: word (distinct), n."""

    def joined(key, group):
        c, lo, hi = key[:3]
        if len(group) < 2:
            return
        cut = max(c - hi, 0)
        middles = [w[lo : len(w) - cut] for w, _ in group]
        for x, y in active_pairs(middles):
            (a, _), (b, n) = group[x], group[y]
            if min(len(a), len(b)) == c and lo + _first_difference(middles[x], middles[y]) < hi:
                yield a, b, n

    def rows(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(7)]
            yield from zip(zip(*cols[:5], strict=True), zip(*cols[5:], strict=True), strict=True)

    def run(batches):
        schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
        out = []
        for key, own in itertools.groupby(rows(batches), lambda r: r[0]):
            for row in joined(key, [w for _, w in own]):
                out.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    common.ship(words.sparkSession)
    dealt = partitions(words, room).select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's chain of forms. forms: word (distinct), form; no chain comes back to itself.

    Chains are doubled until none grows: a form occurs `RATIO` times as often as its word, so that chains are short."""
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("on"))
    while True:
        now = common.written(now, "spelling-roots")
        if now.where("on").isEmpty():
            return now.drop("on")
        further = now.select(F.col("word").alias("root"), F.col("root").alias("to"))
        now = now.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("on"))


def group(words: DataFrame, ratio: int = RATIO, room: int = ROOM) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n; words distinct).

    form: the near word of largest n, ties by code points, if its n is at least `ratio` times the word's, else null;
    root: where the forms lead, the word itself if it has none; n_near: its near words; form_n: the form's n.
    An empty vocabulary gives no rows.
    """
    words = common.written(words.select("word", "n"), "spelling-words")
    best = near_pairs(words, room).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
    is_form = -F.col("b.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n"))
    formed = common.written(formed, "spelling-forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, slips: int | None = None, letters: int = LEAST_LETTERS, seen: int = LEAST_SEEN, ratio: int = RATIO) -> DataFrame:
    """`group` of the words of all documents, with slips if their rate is given.

    Null and empty texts have no words; a null doc_id counts as empty text; repeated rows count as often as they occur;
    other columns are ignored.
    """
    found = runs(docs, letters)
    return group(vocabulary(found if slips is None else with_slips(found, slips), letters, seen), ratio)
