"""Bounded samples of labelled rows, drawn by hash so that every run draws the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def smallest(rows: DataFrame, bound: int, key: str) -> DataFrame:
    """At most `bound` of the rows, those whose hashed key comes first. Reads the rows twice: a count gives
    the share of hash values that is enough, so no task sorts more than it must."""
    n = rows.count()
    h = F.xxhash64(F.col(key))
    if n > bound:
        share = min(1.0, 1.2 * bound / n + 100 / n)
        rows = rows.where(h <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))
    return rows.orderBy(h, F.col(key)).limit(bound)


def agreed(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, column ('0' or '1') of labels: one row an id. Null ids, other labels and ids whose labels differ are left out."""
    use = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").cast("string").alias("v")).where("doc_id is not null and v in ('0', '1')")
    return use.groupBy("doc_id").agg(F.min("v").alias(column), F.max("v").alias("high")).where(F.col(column) == F.col("high")).drop("high")


def texts_with(docs: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """The texts of the sampled keys with their value. keys: a bounded sample, collected and sent to the tasks."""
    chosen = {r[key]: r[value] for r in keys.collect()}
    ids = np.array(sorted(chosen), np.int64)
    values = np.array([chosen[i] for i in ids.tolist()], object)

    def run(batches):
        for b in batches:
            own = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, own)
            hit = np.zeros(len(own), bool)
            if len(ids):
                at = np.minimum(at, len(ids) - 1)
                hit = (ids[at] == own) & np.asarray(b.column(0).is_valid())
            if hit.any():
                take = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(values[at[take]].tolist(), pa.string())], ["doc_id", "text", "value"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, value string")


def training(held: Column) -> Column:
    return ~F.coalesce(held, F.lit(True))
