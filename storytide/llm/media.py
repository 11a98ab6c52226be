"""TIFF columns: text payloads stored as 8-bit images, and a reader of image directories.

The reader walks the chain of image directories of a file in either byte
order, decodes PackBits, LZW or deflate strips and tiles, undoes horizontal
predictors and gives one page at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 192
PAGE_ROWS = 256
STRIP_ROWS = 64
TILE = 64
#: Tags and codes of the format, fixed values.
T_WIDTH, T_HEIGHT, T_BITS, T_COMPRESSION, T_PHOTOMETRIC, T_DESCRIPTION = 256, 257, 258, 259, 262, 270
T_STRIP_AT, T_SAMPLES, T_STRIP_ROWS, T_STRIP_BYTES, T_PLANAR, T_PREDICTOR = 273, 277, 278, 279, 284, 317
T_TILE_WIDTH, T_TILE_HEIGHT, T_TILE_AT, T_TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_KIND = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


class BadImage(ValueError):
    """A file that breaks the format, or uses what the reader does not know."""


def packbits_encode(data: bytes) -> bytes:
    out, at, n = [], 0, len(data)

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(b, k + 128)]
            out.append(bytes([len(part) - 1]) + part)

    for m in re.finditer(rb"(?s)(.)\1{2,}", data):
        literal(at, m.start())
        left = m.end() - m.start()
        while left:
            k = min(128, left)
            out.append(bytes([257 - k if k > 1 else 0]) + m[1])
            left -= k
        at = m.end()
    literal(at, n)
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size:
        if at >= len(data):
            raise BadImage("PackBits data end early")
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            if len(part) != n + 1:
                raise BadImage("PackBits data end early")
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, widths grow one code early, as the format has it."""
    out, acc, bits, width = bytearray(), 256, 9, 9  # begins with a clear code
    table: dict[int, int] = {}
    nxt, code = 258, -1
    for c in data:
        if code < 0:
            code = c
            continue
        key = code << 8 | c
        if (to := table.get(key)) is not None:
            code = to
            continue
        acc, bits = acc << width | code, bits + width
        table[key] = nxt
        nxt += 1
        if nxt == 4094:
            acc, bits = acc << width | 256, bits + width
            table, nxt, width = {}, 258, 9
        elif nxt + 1 > 1 << width:
            width += 1
        if bits >= 64:
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & (1 << rest) - 1, rest
        code = c
    if code >= 0:
        acc, bits, nxt = acc << width | code, bits + width, nxt + 1
        if nxt + 1 > 1 << width and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes((bits + pad) >> 3, "big"))


def lzw_decode(data: bytes, size: int) -> bytes:
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, have, last, width = list(start), [], 0, b"", 9
    acc = bits = at = 0
    while have < size:
        while bits < width:
            if at >= len(data):
                raise BadImage("LZW data end early")
            acc, bits, at = (acc & (1 << bits) - 1) << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big"), bits + 32, at + 4
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if code == 257:
            break
        if code < len(table):
            part = table[code]
        elif code == len(table) and last:
            part = last + last[:1]
        else:
            raise BadImage("LZW code out of range")
        if last:
            table.append(last + part[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(part)
        have += len(part)
        last = part
    if have < size:
        raise BadImage("LZW data end early")
    return b"".join(out)[:size]


def _decode(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        out = data[:size]
    elif kind == PACKBITS:
        out = packbits_decode(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadImage(f"deflate: {e}") from None
    else:
        raise BadImage(f"compression {kind}")
    if len(out) != size:
        raise BadImage("image data end early")
    return out


_ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    description: str | None
    pixels: np.ndarray  # height x width x samples


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """The tags of each image directory along the chain; a chain that returns to itself is an error."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise BadImage("no TIFF header")
    try:
        at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
        while at:
            if at in seen:
                raise BadImage("image directories form a circle")
            seen.add(at)
            tags: dict[int, list] = {}
            n = struct.unpack_from(order + "H", data, at)[0]
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in _KIND:
                    continue
                code, width = _KIND[kind]
                place = at + 10 + 12 * k
                if count * width > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if count > len(data):
                    raise BadImage("a tag is longer than the file")
                tags[tag] = [b"".join(struct.unpack_from(f"{count}c", data, place))] if code == "c" else list(struct.unpack_from(f"{order}{count}{code}", data, place))
            tags[0] = [order]
            yield tags
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error:
        raise BadImage("the file ends early") from None


#: Bytes that a byte of a file may stand for: those of the longest entry of an LZW table, in twelve bits.
RATIO = 4096 * 8 // 12 + 1


def pages(data: bytes) -> Iterator[Page]:
    """The decoded pages of a file. What isn't one, or breaks off, is a BadImage behind the pages before it."""
    walk = enumerate(directories(data))
    while True:
        try:
            k, tags = next(walk)
            page = _page(data, k, tags)
        except StopIteration:
            return
        except (TypeError, ValueError, OverflowError, MemoryError, KeyError, IndexError, struct.error) as e:
            if isinstance(e, BadImage):
                raise
            raise BadImage("a tag that the reader does not know") from None
        yield page


def _page(data: bytes, k: int, tags: dict) -> Page:
    one = lambda t, default=None: tags[t][0] if tags.get(t) else default
    width, height, samples = one(T_WIDTH, 0), one(T_HEIGHT, 0), one(T_SAMPLES, 1)
    kind, predictor = one(T_COMPRESSION, NONE), one(T_PREDICTOR, 1)
    bits = set(tags.get(T_BITS, [1]))
    if not width or not height or not samples:
        raise BadImage("a page without size")
    if bits - {8, 16} or len(bits) != 1 or predictor not in (1, 2) or (one(T_PLANAR, 1) != 1 and samples > 1):
        raise BadImage("samples, predictor or planes that the reader does not know")
    sample = np.dtype("u1" if bits == {8} else one(0) + "u2")
    tiled = T_TILE_AT in tags
    if tiled:
        w, h, at, sizes = one(T_TILE_WIDTH, 0), one(T_TILE_HEIGHT, 0), tags[T_TILE_AT], tags.get(T_TILE_BYTES, [])
    else:
        w, h, at, sizes = width, min(one(T_STRIP_ROWS, height), height), tags.get(T_STRIP_AT, []), tags.get(T_STRIP_BYTES, [])
    across, down = -(-width // max(1, w)), -(-height // max(1, h))
    if not w or not h or len(at) != across * down or len(sizes) != len(at):
        raise BadImage("strips or tiles do not cover the page")
    if down * h * across * w * samples * sample.itemsize > min(1 << 31, RATIO * len(data)):
        raise BadImage("a page of over 2 GB, or larger than the file can hold")
    grid = np.zeros((down * h, across * w, samples), sample.newbyteorder("="))
    for i, (a, n) in enumerate(zip(at, sizes, strict=True)):
        y, x = i // across * h, i % across * w
        rows = h if tiled else min(h, height - y)
        part = np.frombuffer(_decode(kind, data[a : a + n], rows * w * samples * sample.itemsize), sample).astype(grid.dtype).reshape(rows, w, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=grid.dtype)
        grid[y : y + rows, x : x + w] = part
    text = one(T_DESCRIPTION)
    if isinstance(text, int):  # written as bytes
        text = bytes(tags[T_DESCRIPTION])
    return Page(k, width, height, samples, kind, predictor, tiled, text.rstrip(b"\0").decode("utf-8", "replace") if text else None, grid[:height, :width])


def _page_parts(grid: np.ndarray, tiled: bool, predictor: int, kind: int) -> list[bytes]:
    height, width = grid.shape
    if tiled:
        whole = np.zeros((-(-height // TILE) * TILE, -(-width // TILE) * TILE), np.uint8)
        whole[:height, :width] = grid
        parts = [whole[y : y + TILE, x : x + TILE] for y in range(0, whole.shape[0], TILE) for x in range(0, whole.shape[1], TILE)]
    else:
        parts = [grid[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.uint8(0)) for p in parts]
    return [_ENCODE[kind](p.tobytes()) for p in parts]


#: How a page is stored: compression, predictor, tiles; the page's own bytes choose, so equal payloads have equal files.
LAYOUTS = ((PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 2, True), (DEFLATE, 2, False))


def store(payload: bytes, description: str, width: int = WIDTH, page_rows: int = PAGE_ROWS) -> bytes:
    """A TIFF of 8-bit samples, `width` to a row, whose pages hold the payload. Its length must be a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    grid = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for y in range(0, len(grid), page_rows):
        own = grid[y : y + page_rows]
        kind, predictor, tiled = LAYOUTS[zlib.crc32(own.tobytes()) % len(LAYOUTS)]
        parts = _page_parts(own, tiled, predictor, kind)
        at = []
        for p in parts:
            at.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        sizes = [len(p) for p in parts]
        tags = [(T_WIDTH, 3, [width]), (T_HEIGHT, 4, [len(own)]), (T_BITS, 3, [8]), (T_COMPRESSION, 3, [kind]), (T_PHOTOMETRIC, 3, [1]), (T_SAMPLES, 3, [1]), (T_PREDICTOR, 3, [predictor])]
        tags += [(T_TILE_WIDTH, 3, [TILE]), (T_TILE_HEIGHT, 3, [TILE]), (T_TILE_AT, 4, at), (T_TILE_BYTES, 4, sizes)] if tiled else [(T_STRIP_ROWS, 4, [STRIP_ROWS]), (T_STRIP_AT, 4, at), (T_STRIP_BYTES, 4, sizes)]
        if not y:
            tags.append((T_DESCRIPTION, 2, list(description.encode() + b"\0")))
        entries = []
        for tag, typ, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{'B' if typ == 2 else _KIND[typ][0]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, typ, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_payload(text: str, width: int = WIDTH) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with blanks to a positive multiple of the width, bytes before padding)"""
    raw = text.encode()
    return raw.ljust(max(width, -(-len(raw) // width) * width), b" "), len(raw)


def feature(grid: np.ndarray) -> str:
    """Integer statistics of the samples: size, mean and deviation in thousandths, distinct values, steps along rows, edges."""
    x = grid.reshape(grid.shape[0], -1).astype(np.int64)
    n, total = x.size, int(x.sum())
    mean = total * 1000 // n
    deviation = int(np.sqrt(max(0, (int((x * x).sum()) * n - total * total) / n / n)) * 1000)
    step = np.abs(np.diff(x, axis=1))
    return f"h={grid.shape[0]};w={grid.shape[1]};mean={mean};dev={deviation};min={int(x.min())};max={int(x.max())};distinct={len(np.unique(x))};step={int(step.sum()) * 1000 // max(1, step.size)};edges={int((step > 32).sum())}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: every text (null: empty) as a TIFF. Other columns are ignored; repeated rows stay."""

    def run(b):
        media = []
        for t in common.texts_of(b.column(1)):
            payload, n = text_payload(t)
            media.append(store(payload, f"bytes={n}"))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, media binary")


def read_pages(files: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per page of every file: id, page, width, height, samples, compression, predictor, tiled, description, pixels, error.

    pixels: the samples row by row. A null file, or one that cannot be read, gives its good pages
    and one row with the error and null for the rest. Other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, error = [], None
                try:
                    if data.as_py() is None:
                        raise BadImage("null")
                    for p in pages(data.as_py()):
                        rows.append((key, p.page, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.description, p.pixels.tobytes(), None))
                except BadImage as e:
                    error = str(e)
                if error is not None:
                    rows.append((key, *[None] * 9, error))
                if rows:
                    types = (pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "description", "pixels", "error"])

    common.small_batches(files.sparkSession)
    return files.select(F.col(id_column).cast("long"), media_column).mapInArrow(run, "id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, description string, pixels binary, error string")


def _payload(data: bytes | None) -> tuple[list[Page], np.ndarray, int] | None:
    """(pages, their samples under one another, bytes before padding) of a file of store_texts; None for other files."""
    try:
        got = list(pages(data)) if data is not None else []
        said = got[0].description.partition("=") if got and got[0].description else ("", "", "")
        if said[0] != "bytes" or not said[2].isdecimal() or any(p.pixels.shape[2] != 1 or p.pixels.shape[1] != got[0].pixels.shape[1] or p.pixels.dtype != np.uint8 for p in got):
            return None
        return got, np.concatenate([p.pixels[:, :, 0] for p in got]), int(said[2])
    except BadImage:
        return None


def _read(files: DataFrame, one, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """doc_id and the columns that one(pages, grid, n_bytes, file) gives; nulls where a file is null or none of store_texts."""

    def run(b):
        cols: list[list] = [[] for _ in columns]
        for data in b.column(1).to_pylist():
            got = _payload(data)
            for c, v in zip(cols, one(*got, data) if got else [None] * len(columns), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(cols, columns, strict=True))], ["doc_id", *(n for n, _, _ in columns)])

    return common.map_arrow(files.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")), run, "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in columns))


def read_documents(files: DataFrame) -> DataFrame:
    """Per file of store_texts: doc_id, n_bytes, payload (its pages' samples in order), media, feature, n_pages.

    A null file, a broken one and one that store_texts didn't write keep their row, with nulls but for doc_id; null
    ids and repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    columns = [("n_bytes", pa.int64(), "long"), ("payload", pa.binary(), "binary"), ("media", pa.binary(), "binary"), ("feature", pa.string(), "string"), ("n_pages", pa.int32(), "int")]
    return _read(files, lambda got, grid, n, data: (n, grid.tobytes(), data, feature(grid), len(got)), columns)


def digest(files: DataFrame) -> DataFrame:
    """The digest columns of read_documents, computed next to the reader so that payloads don't leave it. Null, broken
    and foreign files as there."""

    def one(_got, grid, n, data):
        payload = grid.tobytes()
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(grid)

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    text = {"payload_sha256", "media_sha256", "feature"}
    return _read(files, one, [(n, pa.string(), "string") if n in text else (n, pa.int64(), "long") for n in names])
