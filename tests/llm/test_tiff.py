import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, empty
from wirelens.llm import tiff


@given(st.binary(max_size=400) | st.binary(min_size=1, max_size=4).map(lambda b: b * 900))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_packbits_of_the_format():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.unpack_bits(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_pages_round_trip(scheme, predictor, tile, kind):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 200, shape).astype(kind) for shape in ((5, 7, 1), (40, 33, 3), (16, 16, 4))]
    rows = list(tiff.read_pages(tiff.write_tiff(images, scheme, predictor, 8, tile)))
    assert [r[0] for r in rows] == [0, 1, 2] and all(r[1] == 3 and r[-1] is None for r in rows)
    for image, row in zip(images, rows, strict=True):
        assert row[2:6] == (image.shape[1], image.shape[0], image.shape[2], 8 * image.itemsize)
        assert np.array_equal(np.frombuffer(row[9], image.dtype).reshape(image.shape), image)


def test_broken_files_give_error_rows(spark):
    good = tiff.write_tiff([np.zeros((4, 4, 1), np.uint8)] * 2)
    df = spark.createDataFrame([(1, good, "x"), (2, b"no", "x"), (3, None, "x"), (4, good[:20], "x"), (5, b"", "x")], "doc_id long, tiff binary, page string")
    rows = tiff.tiff_pages(df, "tiff").collect()
    assert sorted((r.doc_id, r.error is None) for r in rows) == [(1, True), (1, True), (2, False), (4, False), (5, False)]


def test_texts_come_back_whole(spark):
    df = documents(spark)
    got = {}
    for r in tiff.texts_read_back(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = df.collect()
    assert sum(map(len, got.values())) == len(rows)
    for d in rows:
        plain = (d.text or "").encode()
        data = plain + b" " * ((-len(plain)) % 192 or (192 if not plain else 0))
        for r in got[d.doc_id]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(plain), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    alike = {}
    for d in rows:
        alike.setdefault(d.text or "", set()).update((r.media_sha256, r.media_bytes, r.feature) for r in got[d.doc_id])
    assert all(len(x) == 1 for x in alike.values())
    assert tiff.texts_read_back(empty(spark)).count() == 0


def test_false_headers_give_error_rows():
    image = np.arange(60 * 40 * 3, dtype=np.uint8).reshape(60, 40, 3)
    good = bytearray(tiff.write_tiff([image], tiff.DEFLATE, 2, 16))
    entries = int.from_bytes(good[4:8], "little") + 2
    for tag in range(int.from_bytes(good[entries - 2 : entries], "little")):
        for value in (0, 1, 2**31, 2**32 - 1):
            for place in (4, 8):  # the count, the value
                bad = bytearray(good)
                bad[entries + 12 * tag + place : entries + 12 * tag + place + 4] = value.to_bytes(4, "little")
                rows = list(tiff.read_pages(bytes(bad)))
                assert rows and all((r[-1] is None) == (r[-2] is not None) for r in rows)


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_mutated_files_never_raise(scheme, tile):
    rng = np.random.default_rng(scheme + tile)
    images = [rng.integers(0, 9, (40, 30, 3)).astype(np.uint8), rng.integers(0, 999, (17, 20, 1)).astype(np.uint16)]
    good = tiff.write_tiff(images, scheme, 2, 16, tile)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(int(rng.integers(1, 6))):
            bad[int(rng.integers(0, len(bad)))] = int(rng.integers(0, 256))
        for row in tiff.read_pages(bytes(bad[: int(rng.integers(0, len(bad) + 1))] if rng.random() < 0.2 else bad)):
            assert len(row) == len(tiff.PAGE_SCHEMA.fields)


def test_a_bomb_is_cut_short():
    image = np.zeros((1, 8, 1), np.uint8)
    data = bytearray(tiff.write_tiff([image], tiff.DEFLATE, 1, 1))
    bomb = zlib.compress(bytes(50_000_000), 9)
    at = data.index(zlib.compress(bytes(8), 1))
    data = data + bomb
    entries = int.from_bytes(data[4:8], "little") + 2
    for k in range(int.from_bytes(data[entries - 2 : entries], "little")):
        tag = int.from_bytes(data[entries + 12 * k : entries + 12 * k + 2], "little")
        new = {tiff.STRIP_AT: len(data) - len(bomb), tiff.STRIP_SIZE: len(bomb)}.get(tag)
        if new is not None:
            data[entries + 12 * k + 8 : entries + 12 * k + 12] = new.to_bytes(4, "little")
    (row,) = tiff.read_pages(bytes(data))
    assert at and row[-1] is None and row[-2] == bytes(8)


def test_features_equal_a_plain_count(spark):
    df = documents(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in tiff.texts_read_back(df).collect():
        data = tiff.payload(texts[r.doc_id])
        means = [f"{sum(data[c::3]) / (len(data) // 3):.3f}" for c in range(3)]
        bars = [sum(b >> 5 == k for b in data) for k in range(8)]
        assert r.feature == f"mean={','.join(means)};hist={','.join(map(str, bars))}"
