from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gleanery.llm import tiff

from .conftest import SCHEMA, edge_rows


def test_codecs():
    rng = random.Random(0)
    for n in [0, 1, 2, 3, 10, 127, 128, 129, 300, 4000, 9000, 60_000] * 3:
        data = bytes(rng.randrange(rng.choice([1, 2, 5, 256])) for _ in range(n))
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), max(n, 1)) == data
    one = bytes(300_000)  # one byte again and again: the longest words
    assert tiff.lzw_decode(tiff.lzw_encode(one), len(one)) == one and len(one) < tiff.MOST * len(tiff.lzw_encode(one))


def plain_lzw(data):
    """The format's own description, code by code, the bits as text."""
    bits, table, width, word = [f"{256:09b}"], {bytes((i,)): i for i in range(256)}, 9, b""
    free = 258
    for c in data:
        longer = word + bytes((c,))
        if longer in table:
            word = longer
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[longer] = free
        free += 1
        if free == 4094:
            bits.append(f"{256:0{width}b}")
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free > (1 << width) - 1:
            width += 1
        word = bytes((c,))
    if word:
        bits.append(f"{table[word]:0{width}b}")
        free += 1
        width += free > (1 << width) - 1 and width < 12
    bits.append(f"{257:0{width}b}")
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_lzw_is_that_of_the_format():
    rng = random.Random(1)
    for n in (0, 1, 5, 253, 254, 255, 256, 300, 765, 766, 767, 768, 5000, 20_000):
        for values in (2, 256):
            data = bytes(rng.randrange(values) for _ in range(n))
            assert tiff.lzw_encode(data) == plain_lzw(data)
    for n in range(240, 270):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert tiff.lzw_encode(data) == plain_lzw(data)


def test_known_streams():
    assert tiff.packbits_decode(
        bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24
    ) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # 7 7 7 8 8 7 7 6 6, the example of the format's specification
    assert tiff.lzw_decode(bytes.fromhex("80 01 E0 40 80 44 08 0C 06 80 80"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_several_samples():
    pages = [np.random.default_rng(i).integers(0, 256, (h, 16, 3), dtype=np.uint8) for i, h in enumerate((1, 40))]
    for predictor in (1, 2):
        for tile_rows in (0, 16):
            data = tiff.write_tiff(pages, tiff.LZW, predictor, tile_rows)
            assert all(np.array_equal(a, tiff.read_page(data, t)) for a, t in zip(pages, tiff.directories(data), strict=True))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile_rows", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files(compression, predictor, tile_rows, order):
    pages = [np.random.default_rng(i).integers(0, 9, (h, 64), dtype=np.uint8) for i, h in enumerate((1, 17, 300))]
    data = tiff.write_tiff(pages, compression, predictor, tile_rows, order)
    got = [tiff.read_page(data, tags) for tags in tiff.directories(data)]
    assert len(got) == 3 and all(np.array_equal(a, b[:, :, 0]) for a, b in zip(pages, got, strict=True))


def test_pages_of_bad_files(spark):
    good = tiff.write_tiff([np.zeros((2, 64), np.uint8)] * 2)
    entry = lambda tag, value: good.replace(struct.pack("<HHI", tag, 4, 1) + good_value[tag], struct.pack("<HHII", tag, 4, 1, value))
    good_value = {256: struct.pack("<I", 64), 257: struct.pack("<I", 2), 278: struct.pack("<I", 2)}
    broken = [entry(tag, value) for tag in good_value for value in (0, 1 << 31)][:-1]  # more rows a strip than there are is allowed
    assert all(x != good for x in broken)
    rows = [(1, good), (2, b"nonsense"), (3, None), (4, good[:40]), (5, b""), (6, b"II*\0\0\0\0\0"), *((10 + i, x) for i, x in enumerate(broken))]
    got = {}
    for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r.doc_id, []).append((r.page, r.pages, r.height, r.error is None))
    assert got[1] == [(0, 2, 2, True), (1, 2, 2, True)]
    assert all(got[i] == [(-1, 0, None, False)] for i in (2, 3, 4, 5, 6, *range(10, 15)))


@pytest.mark.parametrize("codec", [tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.NONE])
def test_every_codec_on_whole_texts(spark, sf, codec):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for predictor, tile_rows in ((1, 0), (2, 32)):
        media = tiff.text_media(docs, codec=codec, predictor=predictor, tile_rows=tile_rows)
        got = {}
        for r in sorted(tiff.tiff_pages(media).collect(), key=lambda r: r.page):
            assert r.error is None
            got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.pixels)
        for r in docs.collect():
            raw = (r.text or "").encode()
            assert got[r.doc_id] == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_query_and_edges(spark, nothing, tmp_path):
    long = "".join(chr(97 + i % 23) for i in range(200_000))  # over one page
    rows = edge_rows() + [
        (200, long, "en", "s", 1, *edge_rows()[0][5:]), (201, "x" * 64, "en", "s", 1, *edge_rows()[0][5:]),
        (202, "y" * 300, "en", "s", 1, *edge_rows()[0][5:])
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = tiff.op10_tiff(spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((str(r[0]), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by_payload = {}
    for r in got:
        by_payload.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_payload.values())
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert tiff.op10_tiff(spark, str(tmp_path / "none")).count() == 0
