"""Exact top-k search by inner product.

Vectors are dealt out by descending length into parts of bounded size, and the
queries into groups of bounded size; a part meets each group that needs it once,
in one task. In a task candidates come in descending length: once a query's k-th score
exceeds |q| times the longest length left, the query is done. For the others a
singular-value rotation (fitted on a bounded sample; it changes speed, not
results) gathers most of the inner product in the first coordinates, so that a
partial sum plus the product of the residual lengths (Cauchy-Schwarz) rules most
candidates out. What is left is computed exactly, on integers. The longest
vectors of all, a bounded number, give every query a first threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PART = 8192
GROUP = 4096
BLOCK = 1024
HEAD = 1024
SAMPLE = 10_000
#: Scale of the integer grid.
GRID = 256.0
#: Length on the grid from which a vector takes no part: products of shorter ones fit 64 bits.
LONGEST = 2.0**31.5
#: Products below it are whole numbers in 64-bit floating point.
EXACT = 2.0**52


def quantise(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole, finite and not too long, their integers floor(256 x))."""
    good, out = [], []
    for k, v in enumerate(vectors):
        if v is None:
            continue
        a = np.array([np.nan if x is None else x for x in v], np.float64)
        if np.isfinite(a).all() and np.abs(a).max(initial=0) < LONGEST:
            a = np.floor(GRID * a)
            if a @ a < LONGEST**2:
                good.append(k)
                out.append(a)
    return np.array(good, np.int64), out


def prepare(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """row (a number of the row, which stays once the rows are written), vec_id, dim, v (integers as little-endian
    64-bit doubles), norm."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            good, vectors = quantise(b.column(1).to_pylist())
            cols = [pa.array(row + good), b.column(0).take(pa.array(good)), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([float(np.sqrt(v @ v)) for v in vectors], pa.float64())]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "dim", "v", "norm"])

    rows = embeddings.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    common.small_batches(embeddings.sparkSession)
    return rows.mapInArrow(run, "row long, vec_id long, dim int, v binary, norm double")


def matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dim) if len(values) else np.empty((0, dim))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors, the strongest first, as columns."""
    if not len(sample):
        return np.eye(sample.shape[1])
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


def search(queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int, counters: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best among the vectors that reach its floor; ties to smaller ids.

    vectors: by descending length, with their ids and row numbers. A query's own row doesn't count.
    """
    dim = vectors.shape[1]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    qn = np.sqrt((queries * queries).sum(axis=1))
    qr, best = queries @ turn, np.full((len(queries), k), -np.inf)
    head = max(1, dim // 4)
    rest_q = np.sqrt(np.maximum(0, (qr[:, head:] ** 2).sum(axis=1)))
    on, found, pairs = np.arange(len(queries)), [], 0
    for a in range(0, len(vectors), BLOCK):
        least = np.maximum(floor, best[:, -1])
        slack = 1e-6 * (1 + qn * norms[a])
        on = on[qn[on] * norms[a] + slack[on] >= least[on]]
        if not len(on):
            break
        c = vectors[a : a + BLOCK]
        cr = c @ turn
        rest_c = np.sqrt(np.maximum(0, (cr[:, head:] ** 2).sum(axis=1)))
        bound = qr[on, :head] @ cr[:, :head].T + rest_q[on, None] * rest_c[None, :]
        qi, ci = np.nonzero(bound + slack[on, None] >= least[on, None])
        own = rows[a + ci] == query_rows[on[qi]]
        qi, ci = qi[~own], ci[~own]
        pairs += len(qi)
        if not len(qi):
            continue
        exact = qn[on].max() * norms[a] < EXACT
        if exact and len(qi) > 0.1 * bound.size:
            s = (queries[on] @ c.T)[qi, ci]
        else:  # beyond EXACT on 64-bit integers
            x, y = (queries, c) if exact else (queries.astype(np.int64), c.astype(np.int64))
            s = np.concatenate([np.einsum("ij,ij->i", x[on[qi[j : j + 65536]]], y[ci[j : j + 65536]]) for j in range(0, len(qi), 65536)])
        s = s.astype(np.int64)
        q = on[qi]
        up = s >= least[q] - 1e-9 * np.abs(np.where(np.isfinite(least[q]), least[q], 0))
        q, s, i = q[up], s[up], ids[a + ci[up]]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, s, i, nth = q[nth < k], s[nth < k], i[nth < k], nth[nth < k]
        found.append((q, i, s))
        add = np.full((len(queries), k), -np.inf)
        add[q, nth] = s
        best = -np.sort(-np.concatenate([best, add], axis=1), axis=1)[:, :k]
    if counters is not None:
        counters["pairs"] = counters.get("pairs", 0) + pairs
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], i[nth < k], s[nth < k]


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own: a repeated row asks
    as often as it is there, and is found by its copies. Vectors that are null, hold null or non-finite components, or
    have a null id take no part, nor do those of another length than most (of the longer length if as many), as they
    have no product with the rest, nor those whose integers have a Euclidean length of 2^31.5 or more, as their products
    may not fit a long. Scores are exact, also beyond 2^53. An empty table, and one of empty vectors, give no rows.

    The rows meet in pieces: parts of PART vectors by descending length, groups of GROUP queries by the last part they
    need (whose longest vector can still reach the query's first threshold). A group meets only the parts up to the last
    that one of its queries needs. The driver holds a length a part, a number for 8 192 rows.
    """
    spark = embeddings.sparkSession
    rows = common.written(prepare(embeddings, id_column, vector_column).where("dim > 0"), "vectors")
    dims = sorted(rows.groupBy("dim").agg(F.count("*").alias("n")).collect(), key=lambda r: (-r["n"], -r["dim"]))
    schema = "query_id long, rank int, vec_id long, score long"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, n = dims[0]["dim"], dims[0]["n"]
    rows = rows.where(F.col("dim") == dim)
    # a bounded sample for the rotation, and the longest vectors for first thresholds
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * float(1 << 30)).limit(2 * SAMPLE).select("v").toPandas()
    turn = rotation(matrix(sample["v"].tolist(), dim))
    longest = rows.orderBy(F.desc("norm"), "vec_id", "row").limit(HEAD).select("row", "v").toPandas()
    top_rows, top = longest["row"].to_numpy(np.int64), matrix(longest["v"].tolist(), dim)

    parts = max(1, -(-n // PART))
    dealt = common.written(rows.repartitionByRange(parts, F.desc("norm"), "row").select("row", "vec_id", "v", "norm", F.spark_partition_id().alias("part")), "vector-parts")
    lengths = {r["part"]: r["norm"] for r in dealt.groupBy("part").agg(F.max("norm").alias("norm")).collect()}
    numbers = np.array(sorted(lengths), np.int32)
    longest_left = np.array([lengths[p] for p in numbers.tolist()])

    def first(b):
        q, own = matrix(b.column(2).to_pylist(), dim), b.column(0).to_numpy().astype(np.int64)
        s = q @ top.T
        s[own[:, None] == top_rows[None, :]] = -np.inf
        floor = -np.sort(-s, axis=1)[:, k - 1] if s.shape[1] >= k else np.full(len(q), -np.inf)
        floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), floor)
        length = np.sqrt((q * q).sum(axis=1))
        reach = np.where(length > 0, (floor - 1e-6) / (1 + 1e-6) / np.maximum(length, 1e-300), np.where(floor > 1e-6, np.inf, -np.inf))
        need = np.searchsorted(-longest_left, -reach, side="right")  # parts are by descending length
        last = np.where(need > 0, numbers[np.maximum(need, 1) - 1], -1)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(floor), pa.array(last, pa.int32())], ["row", "vec_id", "v", "floor", "last"])

    asked = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    queries = common.written(common.map_arrow(asked, first, "row long, vec_id long, v binary, floor double, last int").where("last >= 0"), "vector-queries")
    groups = max(1, -(-queries.count() // GROUP))
    grouped = common.written(queries.repartitionByRange(groups, F.desc("last"), "row").withColumn("grp", F.spark_partition_id()), "query-groups")
    meetings = grouped.groupBy("grp").agg(F.max("last").alias("to")).select("grp", F.explode(F.sequence(F.lit(0), F.col("to"))).alias("part"))
    asking = grouped.join(meetings, "grp").toDF("q_grp", "row", "vec_id", "v", "floor", "last", "q_part")  # own names: both sides come from meetings
    candidates = dealt.join(meetings, "part")

    def meet(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if c.empty or q.empty:
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        c = c.sort_values(["norm", "vec_id"], ascending=[False, True])
        of = lambda d, name: d[name].to_numpy(np.int64)
        qn, i, s = search(matrix(q["v"].tolist(), dim), of(q, "row"), q["floor"].to_numpy(), matrix(c["v"].tolist(), dim), of(c, "vec_id"), of(c, "row"), turn, k)
        return pd.DataFrame({"row": of(q, "row")[qn], "query_id": of(q, "vec_id")[qn], "vec_id": i, "score": s})

    met = candidates.groupBy("part", "grp").cogroup(asking.groupBy("q_part", "q_grp")).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
