"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of documents in ascending doc_id order. Ids lie in blocks
of 256. Of each block the minimum is subtracted and the differences are packed
at a width that the 95th percentile of them fits; the others (outliers) are
stored whole in an exception list. A table of block starts gives direct access.

File, little-endian:
    magic "TPF1", u32 documents, u64 ids, u64 ids of the shard before this file
    u8[documents] 1 where the doc_id is null, i64[documents] doc_ids
    block section of the document lengths, block section of the ids
Block section:
    u64 values, u32 blocks, u32 bytes of exceptions
    u32[blocks] minimum, u8[blocks] width, u32[blocks + 1] start of each block's packed bits (in bytes)
    u16[blocks] exceptions of each block, packed bits
    exceptions: u16 place in the block, u32 difference, block by block

Files are stored as binary values of a Parquet table (one row a file), so any
store that Spark writes will do, and a lost executor's files are written anew.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import word_encoder

BLOCK = 256
PERCENTILE = 95
MAGIC = b"TPF1"
#: A file is closed after so many ids; a longer single document makes a longer file.
FILE_IDS = 1 << 18


def _bits(x: np.ndarray) -> np.ndarray:
    """The bit length of each number below 2^32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def write_blocks(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint32)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return struct.pack("<QII", 0, 0, 0)
    grid = np.full(blocks * BLOCK, values[-1], np.uint32)
    grid[:n] = values
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    diff = grid - least[:, None]
    need = _bits(diff)
    width = np.partition(need, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    over = need > width[:, None]
    exc_block, exc_at = np.nonzero(over)
    exceptions = np.zeros(len(exc_at), np.dtype([("at", "<u2"), ("diff", "<u4")]))
    exceptions["at"], exceptions["diff"] = exc_at, diff[over]
    diff[over] = 0
    sizes = width * BLOCK // 8
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(sizes, out=start[1:])
    packed = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(diff[own].astype("<u4").view(np.uint8).reshape(-1, BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        rows = np.packbits(bits.reshape(len(own), BLOCK * w), axis=1, bitorder="little")
        packed[start[own][:, None] + np.arange(rows.shape[1])] = rows
    exc = exceptions.tobytes()
    return b"".join((struct.pack("<QII", n, blocks, len(exc)), least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), start.astype("<u4").tobytes(), np.bincount(exc_block, minlength=blocks).astype("<u2").tobytes(), packed.tobytes(), exc))


def read_blocks(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The values of a block section, and the place behind it."""
    n, blocks, exc_bytes = struct.unpack_from("<QII", data, at)
    at += 16
    if not n:
        return np.empty(0, np.uint32), at

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    least, width, start, exc_n = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1).astype(np.int64), take("<u2", blocks)
    packed = take("u1", int(start[-1]))
    exc = take(np.dtype([("at", "<u2"), ("diff", "<u4")]), exc_bytes // 6)
    diff = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        rows = packed[start[own][:, None] + np.arange(w * BLOCK // 8)]
        bits = np.zeros((len(own), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        diff[own] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    diff[np.repeat(np.arange(blocks), exc_n), exc["at"]] = exc["diff"]
    return (diff + least[:, None]).reshape(-1)[:n], at


def read_block(data: bytes, at: int, block: int) -> np.ndarray:
    """One block of a section by its start alone."""
    n, blocks, _ = struct.unpack_from("<QII", data, at)
    heads = at + 16
    least = struct.unpack_from("<I", data, heads + 4 * block)[0]
    width = data[heads + 4 * blocks + block]
    starts = heads + 5 * blocks
    first, total = struct.unpack_from("<I", data, starts + 4 * block)[0], struct.unpack_from("<I", data, starts + 4 * blocks)[0]
    counts = np.frombuffer(data, "<u2", blocks, starts + 4 * (blocks + 1))
    bits_at = starts + 4 * (blocks + 1) + 2 * blocks
    diff = np.zeros(BLOCK, np.uint32)
    if width:
        bits = np.zeros((BLOCK, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, width * BLOCK // 8, bits_at + first), bitorder="little").reshape(BLOCK, width)
        diff = np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, 0].copy()
    exc = np.frombuffer(data, np.dtype([("at", "<u2"), ("diff", "<u4")]), int(counts[block]), bits_at + total + 6 * int(counts[:block].sum()))
    diff[exc["at"]] = exc["diff"]
    return (diff + np.uint32(least))[: n - block * BLOCK]


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((MAGIC, struct.pack("<IQQ", len(doc_ids), len(ids), before), null.tobytes(), keys.tobytes(), write_blocks(lengths), write_blocks(ids)))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc_ids, lengths, ids, ids of the shard before this file)"""
    if data[:4] != MAGIC:
        raise ValueError("no token file")
    docs, n, before = struct.unpack_from("<IQQ", data, 4)
    null = np.frombuffer(data, np.uint8, docs, 24)
    keys = np.frombuffer(data, "<i8", docs, 24 + docs).tolist()
    lengths, at = read_blocks(data, 24 + 9 * docs)
    ids, at = read_blocks(data, at)
    if at != len(data) or len(ids) != n:
        raise ValueError("damaged token file")
    return [None if x else k for x, k in zip(null, keys, strict=True)], lengths, ids, before


FILES = "shard int, file int, documents int, ids long, data binary"


def write(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Encodes every text, appends the end id and writes the files; returns the table of files, read back.

    Shards are ranges of doc_id in ascending order (null first); rows with the same doc_id are ordered
    by the hash of their text. Null or empty texts hold the end id alone. An empty table gives no files.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        shard, file, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close():
            nonlocal file, before, held
            keys, lens, ids = [k for h in held for k in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = [[shard], [file], [len(keys)], [len(ids)], [write_file(keys, lens, ids, before)]]
            file, before, held = file + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], [x.split()[0] for x in FILES.split(", ")])

        for b in batches:
            ids, off = word_encoder(tokenizer).encode(common.texts_of(b.column(1)))
            held.append((b.column(0).to_pylist(), (np.diff(off) + 1).astype(np.uint32), np.insert(ids, off[1:], np.uint32(end_id))))
            if sum(len(h[2]) for h in held) >= FILE_IDS:
                yield close()
        if sum(len(h[0]) for h in held):
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    return common.written(sorted_rows.mapInArrow(run, FILES), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    per_shard = files.groupBy("shard").agg(F.sum("ids").alias("ids")).orderBy("shard").collect()  # one row a task
    base, total = {}, 0
    for r in per_shard:
        base[r["shard"]], total = total, total + r["ids"]

    def run(b):
        cols: list[list] = [[], [], [], []]
        for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys, lens, ids, before = read_file(data.as_py())
            raw, off = ids.astype("<u4").tobytes(), np.cumsum(lens, dtype=np.int64) - lens
            cols[0] += keys
            cols[1] += (off + base[shard] + before).tolist()
            cols[2] += lens.tolist()
            cols[3] += [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(off.tolist(), lens.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def batches(it):
        for b in it:
            for k in range(b.num_rows):
                yield run(b.slice(k, 1))

    return files.select("shard", "data").mapInArrow(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
