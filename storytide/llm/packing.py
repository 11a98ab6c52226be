"""Best-fit packing of token sequences by linear grouping.

Token lengths are integers up to the capacity, so a histogram of lengths (one
bin per length, whatever the size of the corpus) is all that the plan needs:

1. Large lengths, in descending order, are cut into groups of equal
   cardinality, and each group is rounded up to its largest length.
2. Configurations (how many pieces of which rounded sizes share a sequence)
   are optimised over those few sizes: the linear programme of covering all
   counts with the fewest sequences is solved by column generation, a knapsack
   over the sizes' dual prices giving each new configuration. Whole uses are
   kept; the few pieces beyond them get configurations by subset sums.
3. Actual lengths replace the rounded ones.
4. Small lengths go, largest first, into the fullest sequence with room.

The plan is a list of intervals "pieces a..b of length L go to sequences s.. at
offset o", which is applied to the corpus by the rank of each piece among those
of its length. Ranks come from counts per task and length, so no task ever sees
all pieces of one length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import word_encoder

CAPACITY = 2048
#: Sizes that large lengths are rounded up to.
GROUPS = 128
#: Steps of column generation, at most, and the gain below which it ends: they bound the driver's work, not the result's wholeness.
STEPS, GAIN = 2000, 1e-2
#: Lengths of at most this share of the capacity are small.
SMALL = 1 / 16


def _fill(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Uses of the sizes (descending) that fill `room` as far as the counts allow; subset sums are bits of an integer."""
    reach, steps, whole = 1, [], (1 << (room + 1)) - 1
    for s in sizes:
        if s > room:
            continue
        left, unit = min(counts[s], room // s), 1
        while left:  # multiples in powers of two
            n = min(unit, left)
            more = (reach | (reach << (n * s))) & whole
            if more != reach:
                steps.append((s, n, reach))
                reach = more
            left, unit = left - n, unit * 2
        if reach >> room & 1:
            break
    at, uses = reach.bit_length() - 1, {}
    for s, n, before in reversed(steps):
        if not before >> at & 1:
            at -= n * s
            uses[s] = uses.get(s, 0) + n
    return uses


def _best(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each size make the dearest sequence: a knapsack over multiples in powers of two."""
    value, steps = np.zeros(capacity + 1), []
    for k in np.flatnonzero(prices > 1e-9):
        n = 1
        while n * sizes[k] <= capacity:
            got = value[: -n * sizes[k]] + n * prices[k]
            took = np.zeros(capacity + 1, bool)
            took[n * sizes[k] :] = got > value[n * sizes[k] :] + 1e-12
            value[took] = got[took[n * sizes[k] :]]
            steps.append((k, n, took))
            n *= 2
    uses, room = np.zeros(len(sizes), np.int64), int(value.argmax())
    for k, n, took in reversed(steps):
        if took[room]:
            uses[k] += n
            room -= n * int(sizes[k])
    return uses


def configurations(sizes: list[int], counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(uses of each size, times) of configurations that together hold at most `counts` pieces of each size: the
    whole parts of an optimal fractional packing."""
    if not sizes:
        return []
    size, need = np.array(sizes, np.int64), np.array([counts[s] for s in sizes], float)
    columns = np.diag(capacity // size).astype(float)
    amount = need / np.diag(columns)
    # rounding errors of the updates cost optimality at most: uses are whole numbers that the counts bound
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(STEPS):
        prices = inverse.sum(axis=0)
        new = _best(size, np.maximum(prices, 0), capacity)
        if (prices * new).sum() <= 1 + GAIN:
            break
        change = (inverse * new).sum(axis=1)
        ratio = np.full(len(size), np.inf)
        np.divide(np.maximum(amount, 0), change, out=ratio, where=change > 1e-9)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * change
        amount[out], columns[:, out] = ratio[out], new
        inverse[out] /= change[out]
        change[out] = 0
        inverse -= np.outer(change, inverse[out])
    out, left = [], dict(counts)
    for k, x in enumerate(amount):
        uses = {s: int(n) for s, n in zip(sizes, columns[:, k], strict=True) if n}
        times = min([int(x + 1e-6), *(left[s] // n for s, n in uses.items())])
        if times > 0:
            out.append((uses, times))
            for s, n in uses.items():
                left[s] -= n * times
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, first rank, pieces, first sequence, offset), and the number of sequences.

    counts: pieces of each length from 1 to the capacity.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    out: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    n_seq = 0

    def put(length: int, n: int, seq: int, offset: int) -> None:
        out.append((length, used.get(length, 0), n, seq, offset))
        used[length] = used.get(length, 0) + n

    cut = capacity * small
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if n > cut and counts[n]]
    total = sum(c for _, c in large)
    each = -(-total // groups) if total else 1
    # groups of equal cardinality; equal rounded sizes are one size
    actual: dict[int, list[list[int]]] = {}
    taken, size = each, 0
    for n, c in large:
        while c:
            if taken == each or len(large) <= groups:  # few lengths are few sizes as they are
                taken, size = 0, n
            k = c if len(large) <= groups else min(c, each - taken)
            actual.setdefault(size, []).append([n, k])
            taken, c = taken + k, c - k
    left = {s: sum(k for _, k in runs) for s, runs in actual.items()}
    sizes = sorted(left, reverse=True)
    bins: dict[int, list[list[int]]] = {}  # room -> [first sequence, sequences]
    ready = configurations(sizes, left, capacity)
    while sizes:
        if ready:
            uses, times = ready.pop()
        else:
            first = sizes[0]
            left[first] -= 1
            uses = _fill(sizes, left, capacity - first)
            left[first] += 1
            uses[first] = uses.get(first, 0) + 1
            times = min(left[s] // k for s, k in uses.items())
        slots = [s for s in sorted(uses, reverse=True) for _ in range(uses[s])]
        for s, k in uses.items():
            left[s] -= k * times
        # each slot takes `times` pieces in a row; sequences with the same actual lengths form one interval
        rows = []
        for s in slots:
            need, row = times, []
            while need:
                run = actual[s][0]
                k = min(need, run[1])
                row.append([run[0], k])
                run[1] -= k
                need -= k
                if not run[1]:
                    actual[s].pop(0)
            rows.append(row)
        while times:
            n = min(row[0][1] for row in rows)
            offset = 0
            for row in rows:
                put(row[0][0], n, n_seq, offset)
                offset += row[0][0]
                row[0][1] -= n
                if not row[0][1]:
                    row.pop(0)
            bins.setdefault(capacity - offset, []).append([n_seq, n])
            n_seq, times = n_seq + n, times - n
        sizes = [s for s in sizes if left[s]]
    for n in sorted((n for n in counts if n <= cut and counts[n]), reverse=True):
        c = counts[n]
        for room in sorted(r for r in bins if r >= n):
            fit, spans = room // n, bins[room]
            while c and spans:
                seq, have = spans.pop()
                full = min(have, c // fit)
                for j in range(fit if full else 0):
                    put(n, full, seq, capacity - room + j * n)
                if full:
                    bins.setdefault(room - fit * n, []).append([seq, full])
                    c -= full * fit
                seq, have = seq + full, have - full
                if have and c and c < fit:
                    for j in range(c):
                        put(n, 1, seq, capacity - room + j * n)
                    bins.setdefault(room - c * n, []).append([seq, 1])
                    seq, have, c = seq + 1, have - 1, 0
                if have:
                    spans.append([seq, have])
            if not c:
                break
        if c:
            fit = capacity // n
            full, rest = divmod(c, fit)
            for j in range(fit if full else 0):
                put(n, full, n_seq, j * n)
            if full:
                bins.setdefault(capacity - fit * n, []).append([n_seq, full])
                n_seq += full
            for j in range(rest):
                put(n, 1, n_seq, j * n)
            if rest:
                bins.setdefault(capacity - rest * n, []).append([n_seq, 1])
                n_seq += 1
    return out, n_seq


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long, ids binary"


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: the ids of each text and the end id, cut every `capacity` ids.

    task and nth number the pieces of each length within the task that made them.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, off = word_encoder(tokenizer).encode(common.texts_of(b.column(1)))
            cols = [[] for _ in range(8)]
            for doc, a, e in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = np.append(ids[a:e], end_id).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity].tobytes()
                    n = len(part) // 4
                    for col, v in zip(cols, (doc, k, s, n, zlib.crc32(part), task, int(seen[n]), part if keep_ids else None), strict=True):
                        col.append(v)
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into as few sequences of `capacity` ids as the plan finds.

    docs: doc_id, text; other columns are ignored. Returns per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset, and ids (little-endian unsigned 32-bit) if keep_ids.
    A null or empty text is one piece with the end id alone; a null doc_id stays null; repeated
    rows are packed as often as they occur; an empty table gives no rows.
    """
    made = common.written(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    per_task = common.written(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    intervals, _ = plan(counts, capacity, groups)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *(["ids"] if keep_ids else []))
    rows = sorted(intervals)
    length, first, _, seq, offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
    wide = int(first.max(initial=0)) + int(max(counts.values(), default=0)) + 1
    key = length * wide + first  # one sorted array over all lengths; its size depends on the capacity, not on the corpus

    def place(batch):
        n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        at = np.searchsorted(key, n * wide + rank, side="right") - 1
        cols = [*batch.columns[:5], pa.array(seq[at] + rank - first[at]), pa.array(offset[at]), *batch.columns[6:]]
        return pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:5], "sequence_id", "offset", *batch.schema.names[6:]])

    return common.map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids)
