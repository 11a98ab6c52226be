"""Near-duplicate classes by probability MinHash.

Texts become sets of five-word shingles. A shingle of weight w is a Poisson
process of rate w; its arrivals fall on random registers, each register keeps
the shingle that arrives first, and a process ends as soon as its next arrival
is later than every register of its text. Two texts agree on a register with the
probability Jaccard similarity of their weights. All shingles weigh the same,
however often a text repeats them, so that this is the Jaccard similarity of the
sets, which links are decided by. Registers are cut into bands; texts that share
a band are candidates, and candidates are verified on their whole shingle sets.

Equal texts are one node from the start. A group of candidates (at first a
band's bucket) never emits all its pairs. All members are compared with one of
them, the pivot: the one with the most bucket mates, which in a group of copies
is what they are copies of. A group left with several components goes on:

* with few members (SMALL, and MORE times as many each time groups split), those
  of different components are compared;
* else it splits by the shingles that members have and the pivot lacks. Write
  |x| for the size of a set and c = s / (1 + s); x and y are linked if they
  share at least c (|x| + |y|). If x is not linked to the pivot a and y has at
  least `low` shingles, x and y must share need = c (|x| + low) - |x and a| of
  the shingles that a lacks. Where that is positive, all of x's but need - 1
  are enough to meet y, and those left out are the ones that most members have.
  Members for which it is not form a group with those members that are small
  enough to be linked to one of them.

The new groups lack the pivot and begin again. Groups of one pivot are one group. No linked pair that shares a band
is lost, and a member meets one pivot, or few others, in a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textvec as tv

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Groups of so many members are settled by comparing those of different components; the second is what their number
#: is multiplied by each time groups split.
SMALL, MORE = 16, 8
#: Members of one pivot that one task compares with it.
PER_TASK = 256
#: Rows of one task, where tables of a known size are written: what rounds leave over is small, and hundreds of tasks for
#: it take longer than the work.
ROWS_PER_TASK = 20_000
#: Texts of one task, for the same.
TEXTS_PER_TASK = 4_000
#: Characters of texts whose registers are filled together.
BLOCK = 1_000_000
_MULT = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[str], width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) of the distinct shingles of every text, by text and shingle.

    Words are runs of letters and digits, lower-cased. A text of fewer words is one shingle of all of
    them; a text without words has none.
    """
    cp, off = tv.codepoints([t.lower() for t in texts])
    starts, ends = tv.plain_words(cp, off)
    h = tv.word_hashes(cp, starts, ends)
    doc = np.searchsorted(off, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    at = tv.ragged(first, count)
    owner = np.repeat(np.arange(len(texts)), count)
    size = np.minimum(n, width)[owner]
    acc = size.astype(np.uint64)
    for k in range(width):
        has = size > k
        acc[has] += h[at[has] + k] * _MULT[k]
    s = tv.mix(acc)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], s[begin], np.diff(np.append(begin, len(s)))


def registers(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n_texts: int, m: int) -> tuple[np.ndarray, int]:
    """(the first item of each register [text, m], arrivals drawn). Texts without items keep zeros."""
    best, who = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    alone = np.bincount(owner, minlength=n_texts)[owner] == 1
    who.reshape(n_texts, m)[owner[alone]] = items[alone, None]
    on = np.flatnonzero(~alone)
    owner, state, items, rate = owner[on], items[on], items[on], 1.0 / weights[on]
    time, drawn = np.zeros(len(on)), 0
    while len(owner):
        drawn += len(owner)
        state = tv.mix(state + np.uint64(0x9E3779B97F4A7C15))
        u = ((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time = time - np.log(u) * rate
        place = owner * m + (tv.mix(state ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = best[place] == time
        who[place[won]] = items[won]
        last = best.reshape(n_texts, m).max(axis=1)
        go = time < last[owner]
        owner, state, items, rate, time = owner[go], state[go], items[go], rate[go], time[go]
    return who.reshape(n_texts, m), drawn


def compact(owner: np.ndarray, items: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit items of all texts in a row, n + 1 offsets) of items sorted by owner and value."""
    small = (items >> np.uint64(32)).astype("<u4")
    new = np.ones(len(small), bool)
    new[1:] = (small[1:] != small[:-1]) | (owner[1:] != owner[:-1])
    return small[new], np.searchsorted(owner[new], np.arange(n_texts + 1))


def signatures(texts: list[str], n_bands: int = BANDS, rows: int = ROWS, width: int = WORDS) -> tuple[list[list[int] | None], list[int]]:
    """(band keys or None without words, size of the set of 32-bit shingles) of every text."""
    keys: list = []
    sizes: list = []
    for a, b in tv.blocks(texts, BLOCK):
        owner, items, _ = shingles(texts[a:b], width)
        who, _ = registers(owner, items, np.ones(len(items)), b - a, n_bands * rows)
        grid = who.reshape(b - a, n_bands, rows)
        key = np.full((b - a, n_bands), 1, np.uint64) + np.arange(n_bands, dtype=np.uint64)
        for k in range(rows):
            key = tv.mix(key * _MULT[k] + grid[:, :, k])
        n = np.diff(compact(owner, items, b - a)[1]).tolist()
        keys += [k if x else None for k, x in zip(key.view(np.int64).tolist(), n, strict=True)]
        sizes += n
    return keys, sizes


def _tasks(df: DataFrame, rows: int, each: int = ROWS_PER_TASK) -> int:
    """How many tasks so many rows take: all cores are used, and none has much more than `each` rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))


def _in(df: DataFrame, tasks: int | None) -> DataFrame:
    """df in so many tasks at most; partitions that meet in a task are read one after the other."""
    return df if tasks is None else df.coalesce(tasks)


def _node(text):
    """The node of a text: its MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def verify(pairs: DataFrame, sets: DataFrame, tasks: int | None = None) -> DataFrame:
    """a, b, na, nb, both (sizes of the whole shingle sets and of what they share), own (what b has and a lacks,
    sorted; null if not asked for) of the pairs (a, b, size, ask). sets: node, items (sorted, 32 bits each).

    size: members of the group that a is the pivot of; a's set is dealt out to a task for every PER_TASK of them.
    """

    def run(b):
        out: list[list] = [[] for _ in range(4)]
        for x, y, ask in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
            u, v = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
            own = np.setdiff1d(v, u, assume_unique=True)
            for c, w in zip(out, (len(u), len(v), len(v) - len(own), own.view(np.int32) if ask else None), strict=True):
                c.append(w)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["a", "b", "na", "nb", "both", "own"])

    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PER_TASK))
    withb = _in(pairs.withColumn("salt", salt).join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"), tasks)
    dealt = _in(pairs.select("a", salt.alias("salt")).distinct(), tasks).join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    met = _in(withb.join(_in(dealt, tasks), ["a", "salt"]).select("a", "b", "x", "y", "ask"), tasks)
    return common.written(common.map_arrow(met, run, "a binary, b binary, na int, nb int, both int, own array<int>"), "near-pairs")


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node, label: the smallest node of its connected component, for every node of the edges (a, b).

    Each component's root takes the smallest root next to it as its parent, chains of parents are halved
    until they are single steps, and edges are carried to the roots; a few rounds leave no edge.
    """
    written = lambda df, name: common.written(_in(df, tasks), name)
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a").select(F.col("a").alias("root"), "p"), "parents")
        while True:
            up = parent.select(F.col("root").alias("p"), F.col("p").alias("q"))
            if parent.join(up, "p", "left_semi").isEmpty():
                break
            parent = written(parent.join(up, "p", "left").select("root", F.coalesce("q", "p").alias("p")), "parents")
        labels = written(labels.join(parent.withColumnRenamed("root", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        for side in ("a", "b"):
            e = e.join(parent.select(F.col("root").alias(side), F.col("p").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        e = written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


def _labelled(df: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    own = labels.select(F.col("node").alias(column), F.col("label").alias(to))
    return df.join(own, column, "left").withColumn(to, F.coalesce(to, column))


def extend(labels: DataFrame | None, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """The labels once the linked pairs (a, b) are added: only what joins different components is worked on."""
    if labels is None:
        return components(pairs, tasks)
    e = _labelled(_labelled(pairs.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    e = common.written(_in(e, tasks), "edges")
    if e.isEmpty():
        return labels
    more = components(e, tasks).select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(more, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = more.select(F.col("label").alias("node"), F.col("to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return common.written(moved.unionByName(_in(fresh, tasks)), "labels")


def merged(left: DataFrame, tasks: int | None = None) -> DataFrame:
    """key, m, label: the groups of one pivot as one group, in which each member stands once. What copies have in common makes
    most of their groups have the same pivot, and what a member has and the pivot lacks is then listed once, not once a group."""
    pivots = left.groupBy("key").agg(F.min("m").alias("p"))
    rows = left.join(_in(pivots.select("key", F.xxhash64("p.node").alias("to")), tasks), "key")
    return common.written(_in(_in(rows.select(F.col("to").alias("key"), "m", "label"), tasks).distinct(), tasks), "groups")


def refined(left: DataFrame, groups: DataFrame, sims: DataFrame, similarity: float, tasks: int | None = None) -> DataFrame:
    """key, m, label: the groups that the members of the given ones fall into by what their pivot lacks, as `merged` has them.

    left: key, m, label; groups: key, a (the pivot), low; sims: what `verify` found of the pivots.
    """
    c = similarity / (1 + similarity)
    of = sims.where("own is not null").select("a", "b", "both", "own", (F.col("both") >= c * (F.col("na") + F.col("nb")) - 1e-6).alias("linked"))
    rows = left.join(groups, "key").where("m.node <> a").withColumn("b", F.col("m.node")).join(of, ["a", "b"])
    need = F.ceil(c * (F.col("m.n") + F.col("low")) - F.col("both") - 1e-6)
    rows = common.written(_in(rows.select("key", "m", "label", "both", "own", "linked", need.alias("need")), tasks), "members")
    # shingles of one component only bring nothing together: they come first in the order that what is left out is last in
    each = rows.select("key", "m", "label", F.greatest(F.lit(0), F.col("need") - 1).alias("spare"), F.explode("own").alias("s"))
    met = each.groupBy("key", "s").agg(F.count("*").alias("times"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key", "s", "times")
    shared = each.join(_in(met, tasks), ["key", "s"]).groupBy("key", "m", "label", "spare").agg(F.array_sort(F.collect_list(F.struct("times", "s"))).alias("own"))
    some = F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - F.col("spare")).cast("int"))
    split = shared.select(F.explode(some).alias("x"), "key", "m", "label").select(F.xxhash64("key", "x.s").alias("key"), "m", "label")
    loose = rows.where("not linked and need <= 0")
    caps = loose.groupBy("key").agg(F.max(F.col("both") / c - F.col("m.n")).alias("cap"))
    small = rows.join(caps, "key").where(((~F.col("linked")) & (F.col("need") <= 0)) | (F.col("m.n") <= F.col("cap") + 1e-6))
    split = common.written(_in(split, tasks).unionByName(_in(small.select(F.xxhash64("key", F.lit("small")).alias("key"), "m", "label"), tasks)), "groups")
    several = split.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    return merged(split.join(_in(several, tasks), "key", "left_semi"), tasks)


def links(docs: DataFrame, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, width: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, node; links: a, b, similarity between nodes; labels: node, label)

    docs: id, text. A null text has no node; a text without words has one without links; null ids and repeated
    rows stay in `rows`; an empty table gives three empty ones. The links connect every class; two members of a
    class that others connect need not be linked themselves.
    """
    source = docs.select("id", F.col("text").cast("string").alias("text")).withColumn("node", _node(F.col("text")))

    def sign(b):
        keys, sizes = signatures(common.texts_of(b.column(1)), n_bands, rows, width)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["id", "node", "bands", "n"])

    signed = common.written(common.map_arrow(source.select("id", "text", "node"), sign, "id long, node binary, bands array<long>, n int"), "signatures")
    count = signed.count()
    tasks, many = _tasks(signed, count), _tasks(signed, count * n_bands)
    texts = _in(signed.where("node is not null and bands is not null").groupBy("node").agg(F.min(F.struct("bands", "n")).alias("s")), many)
    keyed = texts.select("node", F.col("s.n").alias("n"), F.explode("s.bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    mated = common.written(_in(keyed.join(shared, "key"), many), "buckets")
    weight = _in(mated.groupBy("node").agg(F.negate(F.sum("mates")).alias("w")), tasks)
    left = merged(common.written(_in(mated.join(weight, "node").select("key", F.struct("w", "n", "node").alias("m"), F.col("node").alias("label")), many), "groups"), many)

    def pack(b):
        owner, items, _ = shingles(common.texts_of(b.column(1)), width)
        small, off = compact(owner, items, b.num_rows)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([small[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["node", "items"])

    whole = source.where("node is not null").select("node", "text").join(weight.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = common.written(common.map_arrow(_in(whole, _tasks(signed, count, TEXTS_PER_TASK)), pack, "node binary, items binary"), "shingle-sets")

    c = similarity / (1 + similarity)
    found = labels = rest = None
    few, alike = SMALL, 0
    while (members := left.count()) or rest is not None:
        tasks = _tasks(left, members + alike)
        groups = left.groupBy("key").agg(F.min("m").alias("p"), F.count("*").alias("size"), F.min("m.n").alias("low"))
        groups = common.written(_in(groups.select("key", F.col("p.node").alias("a"), "size", "low"), tasks), "pivots")
        # a group has a pivot of its own, so that no pair comes twice
        pairs = left.join(groups, "key").where("m.node <> a").select("a", F.col("m.node").alias("b"), "size", F.lit(True).alias("ask"))
        if rest is not None:
            pairs = pairs.unionByName(rest)
        sims = verify(pairs, sets, _tasks(left, members + alike, TEXTS_PER_TASK))
        linked = sims.where(F.col("both") >= c * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
        found = linked if found is None else found.unionByName(linked)
        labels = extend(labels, linked, tasks)
        now = _labelled(left.select("key", "m", F.col("m.node").alias("node")), labels, "node", "label")
        several = now.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
        open_ = common.written(_in(now.join(_in(several, tasks), "key", "left_semi").select("key", "m", "label"), tasks), "groups")
        unsettled = open_.count()
        if not unsettled:
            break
        # the pivot has met all of its group
        tasks = _tasks(left, unsettled)
        others = open_.join(groups.where(F.col("size") <= few), "key").where("m.node <> a")
        side = lambda k: others.select("key", F.col("m.node").alias(k), F.col("label").alias(f"l{k}"), F.col("m.n").alias(f"n{k}"))
        like = (F.col("na") >= similarity * F.col("nb") - 1e-6) & (F.col("nb") >= similarity * F.col("na") - 1e-6)
        rest = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & like)
        rest = common.written(_in(rest.select("a", "b", F.lit(1).cast("long").alias("size"), F.lit(False).alias("ask")).distinct(), tasks), "candidates")
        left = refined(open_, groups.where(F.col("size") > few), sims, similarity, tasks)
        few *= MORE
        alike = rest.count()
        rest = rest if alike else None
        needed = left.select("m.node")
        if rest is not None:
            needed = needed.union(rest.select("a")).union(rest.select("b"))
        sets = common.written(_in(sets.join(needed.distinct(), "node", "left_semi"), _tasks(left, unsettled, TEXTS_PER_TASK)), "shingle-sets")
    if found is None:
        nodes = weight.select("node")
        empty = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
        return signed.select("id", "node"), empty, nodes.select("node", F.col("node").alias("label")).limit(0)
    return signed.select("id", "node"), found, labels


def classes(docs: DataFrame, id_column: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Per document: id, class_id (the smallest id of its class), class_size.

    docs: id, text; other columns are ignored. Documents are of one class when links of at least the
    given similarity, or equal texts, connect them. A null text is alone in its class; texts without
    words are linked to equal texts only; repeated rows stay; a null id stays null and names no class
    unless the whole class has none; an empty table gives no rows.
    """
    rows, _, labels = links(docs.select(F.col(id_column).cast("long").alias("id"), "text"), similarity)
    tasks = _tasks(rows, rows.count())
    own = rows.where("node is not null")
    per_node = _in(own.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")), tasks)
    labelled = _in(per_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), tasks)
    per_class = labelled.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = common.written(_in(labelled.select("node", "label").join(_in(per_class, tasks), "label").select("node", "class_id", "class_size"), tasks), "classes")
    found = own.join(of_node, "node").select("id", "class_id", "class_size")
    alone = rows.where("node is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone).withColumnRenamed("id", id_column)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each class."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = classes(numbered.select(row, "text"), row, similarity)
    kept = found.where(F.col(row) == F.col("class_id")).select(row)
    return numbered.join(kept, row, "left_semi").drop(row).select(*docs.columns)
