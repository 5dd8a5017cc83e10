import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from helpers_llm import awkward, documents

from panelyard.llm import media as M


def test_codecs_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((5, 7, 3), (1, 1, 3), (4, 4, 3)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        assert (M.decode(M.encode_netpbm(pixels)) == pixels).all() and (M.decode(M.encode_bmp(pixels)) == pixels).all()
    grey = rng.integers(0, 256, (3, 5), np.uint8)
    assert (M.decode(M.encode_netpbm(grey)) == grey).all()
    text = b"P2 # note\n5 3\n# more\n255\n" + " ".join(map(str, grey.ravel())).encode()
    assert (M.decode(text) == grey).all()
    assert (M.decode(b"P3\n1 2 255\n1 2 3 4 5 6") == np.array([[[1, 2, 3]], [[4, 5, 6]]])).all()


def test_area_resize_equals_the_mean_of_covered_area():
    rng = np.random.default_rng(2)
    for (h, w), (a, b) in (((12, 9), (4, 3)), ((5, 7), (3, 4)), ((2, 3), (8, 9))):
        pixels = rng.random((h, w))
        fine = np.kron(pixels, np.ones((a, b)))  # every pixel in a x b parts, so every output pixel covers whole parts
        want = fine.reshape(a, h, b, w).mean(axis=(1, 3))
        assert M.area_resize(pixels, a, b) == pytest.approx(want)


def test_texts_come_back_from_their_pictures(spark):
    rows = awkward()
    got = M.text_features(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = set()
    for d, t, _, _ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.add((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert {(r.doc_id, r.n_bytes, r.samples, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert all(r.height * r.width * 3 == r.samples and r.media_bytes > r.samples and len(r.dhash) == 16 for r in got)
    assert all(np.load(io.BytesIO(r.tile)).shape == (M.TILE, M.TILE) for r in got)


def test_unreadable_pictures_give_nulls(spark):
    broken = [b"P2 1 1 255 300", b"P2 2 1 255 -1 4", b"P5 99999999999999999999 1 255\nab", b"P2 0 0 255\n", b"P5 0 3 255\n", b"P2 2 1 100 7 101", b"P2 1 1 255 x", b"P2 1 1 0 0"]
    broken += [b"BM" + bytes(8) + b"\x36\0\0\0" + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(12) for w, h in ((0, 1), (1, 0), (-1, 1), (2**31 - 1, 2**31 - 1))]
    scaled = [(50, b"P2 3 1 100\n0 50 100"), (51, b"P2 3 1 200\n0 100 200"), (52, b"P5 3 1 255\n\x00\x80\xff")]
    other = {r.k: r for r in M.picture_features(spark.createDataFrame([*enumerate(broken), *scaled], "k int, media binary")).collect()}
    assert all(other[k].samples is None and other[k].dhash is None and other[k].media_bytes == len(b) for k, b in enumerate(broken))
    assert other[50].dhash == other[51].dhash and np.load(io.BytesIO(other[50].tile)).max() == 255 and (other[50].tile == other[51].tile)
    rows = [(1, None), (2, b""), (3, b"BM"), (4, b"P6\n5 5\n255\nshort"), (5, b"P6\n1 1\n255\nabc"), (6, b"garbage")]
    got = {r.k: r for r in M.picture_features(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert [k for k in got if got[k].samples is not None] == [5] and got[1].media_bytes is None and got[6].media_bytes == 7
