import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from qacorpus.llm import tiff_pages as T


def test_round_trips_of_the_codecs():
    rnd = random.Random(0)
    for n in (0, 1, 5, 300, 9000, 60000):
        for kinds in (1, 2, 20, 256):
            data = bytes(rnd.randrange(kinds) for _ in range(n))
            assert T.unlzw(T.lzw(data), n) == data
    for width in (1, 3, 4, 64, 192):
        for kinds in (1, 2, 200):
            rows = np.array([[rnd.randrange(kinds) for _ in range(width)] for _ in range(9)], np.uint8)
            assert T.unpackbits(T.packbits(rows), rows.size) == rows.tobytes()


def test_known_streams():
    # the LZW example of the TIFF 6.0 specification's kind: clear, 7 7 7 8 8 7 7 6 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert T.unlzw(data, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert T.unpackbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"


def _big_endian(tags, data):
    """A file with byte order MM: pixels at 8, directory behind."""
    entries = b""
    for tag, kind, value in sorted(tags):
        entries += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    return b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0)


def test_big_endian_samples_and_planes():
    pixels = np.arange(4 * 3 * 2, dtype=">u2").reshape(3, 4, 2)
    differences = pixels.astype(np.int64)
    differences[:, 1:] -= pixels[:, :-1].astype(np.int64)
    data = zlib.compress(differences.astype(">u2").tobytes())
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 8), (277, 3, 2), (278, 3, 3), (273, 4, 8), (279, 4, len(data)), (317, 3, 2)]
    (page,) = T.read_pages(_big_endian(tags, data))
    assert page.error is None and page.pixels == pixels.astype("<u2").tobytes()


@pytest.mark.parametrize("form", T.FORMS + [(T.NONE, 1, True), (T.NONE, 2, False)])
def test_files_of_several_pages(form):
    rnd = random.Random(1)
    payload = bytes(rnd.randrange(40, 90) for _ in range(192 * 150)) + b" " * 192
    found = T.read_pages(T.write_tiff(payload, 192, *form, page_rows=64, part=48))
    assert [p.height for p in found] == [64, 64, 23] and b"".join(p.pixels for p in found) == payload


def test_broken_files():
    good = T.write_tiff(b"x" * 192 * 3, 192, T.DEFLATE, 1, False)
    assert T.read_pages(None)[0].error and T.read_pages(b"")[0].error and T.read_pages(b"GIF89a..")[0].error
    for n in range(4, len(good), 7):
        assert all(p.error or p.pixels for p in T.read_pages(good[:n]))
    loop = bytearray(good)
    loop[-4:] = good[4:8]  # the directory names itself as the next
    assert len(T.read_pages(bytes(loop))) == 1
    for wrong in ([(256, 4, 0)], [(278, 4, 0)], [(256, 4, 3_000_000), (257, 4, 3_000_000), (278, 4, 3_000_000)], [(257, 4, 2**32 - 1)], [(277, 3, 0)], [(322, 4, 0), (323, 4, 16), (324, 4, 8), (325, 4, 4)]):
        tags = {256: (256, 4, 2), 257: (257, 4, 2), 258: (258, 3, 8), 277: (277, 3, 1), 278: (278, 4, 2), 273: (273, 4, 8), 279: (279, 4, 4)} | {t[0]: t for t in wrong}
        (page,) = T.read_pages(_big_endian(list(tags.values()), b"abcd"))
        assert page.error and page.pixels is None


def test_query_and_pages(spark):
    texts = [None, "", "a", "é" * 5000, "b" * 192, "b" * 192, "word " * 60000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(2)
    rows = {r.doc_id: r for r in T.stored_features(T.store_texts(df)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[4][1:] == rows[5][1:] and rows[0].feature == rows[1].feature
    found = T.pages(T.store_texts(df), "doc_id", "media").orderBy("doc_id", "page").collect()
    assert [r.page for r in found if r.doc_id == 6] == [0, 1, 2, 3] and all(r.error is None for r in found)
    broken = spark.createDataFrame([(1, None), (2, b"abc")], "k int, m binary")
    assert [bool(r.error) for r in T.pages(broken, "k", "m").collect()] == [True, True]
    assert T.stored_features(T.store_texts(df.filter("false"))).count() == 0


def test_features_of_broken_files(spark):
    good = T.write_tiff(T.payload_of(b"a text"), T.ROW, T.DEFLATE, 1, False)
    files = spark.createDataFrame([(1, 6, bytearray(good)), (2, 6, None), (3, 6, bytearray(b"no tiff")), (4, 6, bytearray(good[:40])), (5, 6, bytearray())], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in T.stored_features(files).collect()}
    assert rows[1].payload_bytes == 192 and rows[1].feature.startswith("1:")
    assert all(rows[k].payload_bytes is None and rows[k].feature is None for k in (2, 3, 4, 5))
    assert rows[2].media_bytes is None and rows[3].media_bytes == 7 and rows[5].media_bytes == 0
