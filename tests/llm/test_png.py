import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from streetflow.llm import png


@pytest.mark.parametrize("filters", [0, 1, 2, 3, 4, None])
def test_round_trip(filters):
    r = random.Random(7)
    data = png.pad(bytes(r.choices(range(256), k=576 * 7 - 5)))
    stored = png.encode(data, filters=filters)
    assert png.decode(stored).tobytes() == data


def test_pad():
    assert len(png.pad(b"")) == 576 and png.pad(b"x" * 576) == b"x" * 576 and len(png.pad(b"x" * 577)) == 1152


def test_damage_is_found():
    stored = bytearray(png.encode(png.pad(b"hello" * 500)))
    for at in (0, 20, len(stored) // 2, len(stored) - 3):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            png.decode(bytes(bad))
    with pytest.raises(ValueError):
        png.decode(bytes(stored[:-12]))


def test_hash_keeps_under_noise():
    r = np.random.default_rng(1)
    a = np.kron(r.integers(0, 200, (8, 8)), np.ones((8, 72))).astype(np.uint8)
    b = np.clip(a + r.integers(0, 4, a.shape), 0, 255).astype(np.uint8)
    x, y = (int(png.cosine_hash(i), 16) for i in (a, b))
    assert (x ^ y).bit_count() <= 8


def test_query_on_edge_cases(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "é" * 300), (3, "é" * 300), (None, "x" * 576), (4, "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = png.query(spark, str(tmp_path)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].payload_sha256 == by[2].payload_sha256 and by[1].payload_bytes == 576 and by[1].n_bytes == 0
    assert by[3].n_bytes == 600 and by[3].payload_bytes == 1152 and by[None].payload_bytes == 576
    df.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert png.query(spark, f"{tmp_path}/e").count() == 0


def plain_read(data):
    """(width, filters used, samples) of a grey PNG, byte by byte from the format's definition."""
    at, parts, width = 8, [], 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + n)[0]
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        parts += [body] * (kind == b"IDAT")
        at += 12 + n
    raw, out, used, above = zlib.decompress(b"".join(parts)), b"", set(), bytes(width)
    for y in range(0, len(raw), width + 1):
        kind, line = raw[y], bytearray(raw[y + 1 : y + 1 + width])
        used.add(kind)
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, nearest)[kind]) & 255
        above = bytes(line)
        out += above
    return width, used, out


def plain_hash(img):
    """Signs of the low cosine terms of the image reduced to 32 x 32 by area, from the formula."""
    h, w = img.shape

    def cells(n):
        return [[max(0.0, min((i + 1) * n / 32, k + 1) - max(i * n / 32, k)) * 32 / n for k in range(n)] for i in range(32)]

    small = np.array(cells(h)) @ img.astype(float) @ np.array(cells(w)).T
    cos = np.array([[np.cos(np.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)])
    flat = np.round((cos @ small @ cos.T).ravel() / 1024, 6)
    bits = "".join("1" if k and v > np.median(flat[1:]) else "0" for k, v in enumerate(flat))
    return f"{int(bits, 2):016x}"


def test_query_matches_an_independent_reader(spark):
    """Every column from the texts alone, and the stored bytes read by the plain reader; several filters are in use."""
    sf, used = "/root/testdata/sf0.001", set()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stored = {r.doc_id: bytes(r.media) for r in png.to_media(docs).collect()}
    got = {r.doc_id: r for r in png.query(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(rows):
        data, r = (text or "").encode(), got[i]
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        if n % 5 == 0 and len(data) < 20_000:
            width, kinds, samples = plain_read(stored[i])
            used |= kinds
            assert width == 576 and samples == payload
            assert r.feature == plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 576))
    assert len(used) >= 3, "filters are chosen per line"


def test_many_images_are_undone_together():
    r = np.random.default_rng(4)
    images = [r.integers(0, 256, (h, 9), dtype=np.uint8) for h in (1, 3, png.BAND, png.BAND + 1, 2 * png.BAND + 5, 1)]
    for shift in range(5):
        lines = [png.filter_rows(x, ((np.arange(len(x)) + shift) % 5).astype(np.uint8)) for x in images]
        assert all(np.array_equal(a, b) for a, b in zip(png.unfilter_many(lines), images))
    with pytest.raises(ValueError):
        png.unfilter_rows(np.full((1, 4), 5, np.uint8))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "old", "old", 2)], "doc_id long, text string, media string, features string, rows int")
    got = png.media_features(png.to_media(df)).first()
    assert got.features.payload_bytes == 576 and got.rows == 2 and bytes(got.media)[:4] == b"\x89PNG"
