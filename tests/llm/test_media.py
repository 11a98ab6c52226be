"""TIFF: round trips, foreign layouts, broken files."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from storytide.llm import media

from .frames import ODD, none, odd

RNG = np.random.default_rng(3)
BLOBS = [b"a", b"aaaa" * 100, bytes(range(256)) * 30, RNG.integers(0, 256, 20000, dtype=np.uint8).tobytes(), b"ab" * 9000, b"\0" * 200_000]


@pytest.mark.parametrize("data", BLOBS)
def test_codecs(data):
    assert media.packbits_decode(media.packbits_encode(data), len(data)) == data
    assert media.lzw_decode(media.lzw_encode(data), len(data)) == data


def test_known_streams():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert media.packbits_decode(packed, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    # 7 7 7 8 8 7 7 6 6 as the format's description codes it: clear, 7, 258, 8, 8, 258, 6, 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    bits += "0" * (-len(bits) % 8)
    assert list(media.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8, "big"), 9)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]


@pytest.mark.parametrize("layout", range(len(media.LAYOUTS)))
def test_layouts(layout, monkeypatch):
    monkeypatch.setattr(media, "LAYOUTS", (media.LAYOUTS[layout],))
    payload = RNG.integers(0, 256, 192 * 300, dtype=np.uint8).tobytes()
    got = list(media.pages(media.store(payload, "bytes=1")))
    assert [p.height for p in got] == [256, 44] and [p.description for p in got] == ["bytes=1", None]
    assert b"".join(p.pixels.tobytes() for p in got) == payload


def test_foreign_file():
    """Big-endian, 16 bits, three samples, predictor 2, one strip."""
    grid = RNG.integers(0, 65536, (5, 7, 3), dtype=np.uint16)
    diff = grid.copy()
    diff[:, 1:] -= grid[:, :-1]
    data = zlib.compress(diff.astype(">u2").tobytes())
    tags = [(256, 3, 7), (257, 3, 5), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 3), (278, 3, 5), (279, 4, len(data)), (317, 3, 2)]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0\0\0\0"
    file = b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + ifd
    (p,) = media.pages(file)
    assert np.array_equal(p.pixels, grid)


def test_broken_files(spark):
    good = media.store(b"x" * 192, "bytes=1")
    circle = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, at)[0]
    struct.pack_into("<I", circle, at + 2 + 12 * n, at)
    files = [(1, None), (2, b""), (3, b"II*\0"), (4, good[:40]), (5, bytes(circle)), (6, good)]
    rows = media.read_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert {r.id for r in rows if r.error} == {1, 2, 3, 4, 5}
    assert [(r.id, r.pixels) for r in rows if not r.error and r.id == 6] == [(6, b"x" * 192)]


def test_documents_of_other_files(spark):
    """Null, broken and foreign files keep their rows, without values."""
    good, foreign = media.store(b"y" * 384, "bytes=300"), media.store(b"x" * 192, "a picture")
    files = spark.createDataFrame([(1, None, 0), (2, b"", 0), (3, good[:40], 0), (4, foreign, 0), (5, good, 0), (None, good, 0)], "doc_id long, media binary, feature int")
    for read in (media.digest, media.read_documents):
        rows = read(files).collect()
        assert len(rows) == 6 and {r.doc_id for r in rows if r.n_bytes is None and r.feature is None} == {1, 2, 3, 4}
        assert [r.n_bytes for r in rows if r.n_bytes] == [300, 300]
    assert bytes(media.read_documents(files).where("doc_id = 5").first().payload) == b"y" * 384


def test_documents(spark):
    files = media.store_texts(odd(spark))
    got = {(r.doc_id, r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in media.digest(files).collect()}
    want = set()
    for i, t, _ in ODD:
        raw = (t or "").encode()
        padded = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        want.add((i, hashlib.sha256(padded).hexdigest(), len(raw), len(padded), zlib.crc32(padded[-16:])))
    assert got == want
    rows = media.read_documents(files).collect()
    assert sorted((r.doc_id or 0, bytes(r.payload[: r.n_bytes]).decode()) for r in rows) == sorted((i or 0, t or "") for i, t, _ in ODD)
    assert len(media.digest(files).collect()) == len(ODD)
    assert media.digest(media.store_texts(none(spark))).count() == 0


def test_ten_thousand_broken_files():
    """Files with bytes changed, cut out or added, and tags of other types: pages, or a BadImage."""
    rng = np.random.default_rng(11)
    whole = [media.store(rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() if n % 2 else b" " * 192 * n, f"bytes={n}") for n in (1, 2, 3, 8)]
    bad = 0
    for _ in range(10_000):
        data = bytearray(whole[rng.integers(len(whole))])
        heads = len(data) - 12 * 14  # directories come last
        for _ in range(rng.integers(1, 6)):
            at = int(rng.integers(max(0, heads), len(data))) if rng.random() < 0.7 else int(rng.integers(len(data)))
            way = rng.random()
            if way < 0.8:
                data[at] = int(rng.choice([0, 1, 2, 3, 5, 11, 12, 255, int(rng.integers(256))]))
            elif way < 0.9:
                del data[at : at + int(rng.integers(1, 9))]
            else:
                data[at:at] = rng.integers(0, 256, 4, dtype=np.uint8).tobytes()
            if not data:
                data = bytearray(b"I")
        try:
            list(media.pages(bytes(data)))
        except media.BadImage:
            bad += 1
    assert bad > 5000


def test_description_of_bytes(spark):
    """A description with the type of bytes is read; the file is still one of store_texts."""
    data = bytearray(media.store(b"x" * 192, "bytes=192"))
    at = data.index(struct.pack("<HH", media.T_DESCRIPTION, 2))
    data[at + 2 : at + 4] = struct.pack("<H", 1)
    assert [p.description for p in media.pages(bytes(data))] == ["bytes=192"]
    data[at + 2 : at + 4] = struct.pack("<H", 11)  # numbers with fractions
    files = spark.createDataFrame([(1, bytes(data))], "doc_id long, media binary")
    assert [r.error is None for r in media.read_pages(files).collect()] == [False] or media.digest(files).first()["n_bytes"] is None


def test_a_small_file_asks_for_little():
    tags = [(media.T_WIDTH, 4, 40000), (media.T_HEIGHT, 4, 40000), (media.T_BITS, 3, 8), (media.T_STRIP_AT, 4, 8), (media.T_STRIP_BYTES, 4, 4)]
    data = b"II*\0\x0c\0\0\0abcd" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    with pytest.raises(media.BadImage, match="larger than the file can hold"):
        list(media.pages(data))
