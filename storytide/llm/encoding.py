"""BPE encoding and decoding of text columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import byte_encoder


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids: the ids of every text as a list of ints. Null text is empty, and an empty text has no ids."""

    def run(b):
        ids, off = byte_encoder(tokenizer).encode(common.texts_of(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype("int32")))], ["doc_id", "ids"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text of doc_id, ids. Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    import numpy as np

    def run(b):
        lists = [x or [] for x in b.column(1).to_pylist()]
        off = np.cumsum([0, *map(len, lists)])
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(off[-1]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(byte_encoder(tokenizer).decode(ids, off), pa.string())], ["doc_id", "text"])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one pass.

    Null text is empty; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(b):
        e = byte_encoder(tokenizer)
        ids, off = e.encode(common.texts_of(b.column(1)))
        own = [b.column(0), pa.array((off[1:] - off[:-1]).tolist(), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in e.listed(ids, off)], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in e.decode(ids, off)], pa.string())]
        return pa.RecordBatch.from_arrays(own, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
