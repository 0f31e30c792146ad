"""op7 as a whole against a byte-by-byte reading: PNG with chosen filters, what is read back, the cosine hash; groups of images against single ones."""

import hashlib
import math
import os
import statistics
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from netquarry.llm import media


def guess(kind, a, b, c):
    p = a + b - c
    return [0, a, b, (a + b) // 2, min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]][kind]


def plain_png(padded, n):
    rows = [padded[i : i + 64] for i in range(0, len(padded), 64)]
    lines = b""
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else bytes(64)
        told = [bytes((v - guess(kind, row[x - 1] if x else 0, above[x], above[x - 1] if x else 0)) & 255 for x, v in enumerate(row)) for kind in range(5)]
        kind = min(range(5), key=lambda k: (sum(min(v, 256 - v) for v in told[k]), k))
        lines += bytes([kind]) + told[kind]
    packed = zlib.compress(lines, 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    parts = [chunk(b"IDAT", packed[i : i + 65536]) for i in range(0, len(packed), 65536)]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)) + chunk(b"nqLn", struct.pack(">Q", n)) + b"".join(parts) + chunk(b"IEND", b"")


def plain_hash(padded):
    rows = [padded[i : i + 64] for i in range(0, len(padded), 64)]
    bands = lambda n: [range(k * n // 32, k * n // 32 + max(1, (k + 1) * n // 32 - k * n // 32)) for k in range(32)]
    grid = [[statistics.fmean(rows[y][x] for y in ys for x in xs) for xs in bands(64)] for ys in bands(len(rows))]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    wave = lambda k, x: math.cos(math.pi * (2 * x + 1) * k / 64) * scale(k)
    part = [[sum(wave(v, x) * row[x] for x in range(32)) for v in range(8)] for row in grid]
    low = [round(sum(wave(u, y) * part[y][v] for y in range(32)), 4) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return f"{int('0' + ''.join('1' if x > middle else '0' for x in low[1:]), 2):016x}"


def plain(text):
    own = (text or "").encode()
    padded = own + bytes(-len(own) % 64 or (0 if own else 64))
    png = plain_png(padded, len(own))
    return len(own), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(png), hashlib.sha256(png).hexdigest(), plain_hash(padded)


@pytest.mark.parametrize("source", ["made", "table"])
def test_the_query_is_what_its_plain_reading_says(spark, tmp_path, source):
    if source == "made":
        texts = [None, "", "a", "x" * 64, "é" * 4000, "line of text\n" * 700, "".join(chr(33 + i * i % 90) for i in range(5000)), "a", "\x00\xff" * 40]
        folder = str(tmp_path)
        pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "media": "clash", "n_bytes": -1}).to_parquet(f"{folder}/documents.parquet")
    else:
        folder = "/root/testdata/sf0.001"
        if not os.path.isdir(folder):
            pytest.skip("needs the test tables")
        rows = pd.read_parquet(f"{folder}/documents.parquet")
        texts = dict(zip(rows.doc_id, rows.text, strict=True))
    want = sorted((i, *plain(x)) for i, x in (texts.items() if source == "table" else enumerate(texts)))
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in media.op7_media_columns(spark, folder).collect())
    assert got == want


def test_every_filter_is_used_and_undone_in_groups(monkeypatch):
    rng = np.random.default_rng(3)
    ramp = (np.arange(64)[None, :] * rng.integers(0, 5, (300, 1)) + np.arange(300)[:, None] * 3).astype(np.uint8)
    noise = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    smooth = np.cumsum(np.cumsum(rng.integers(-2, 3, (200, 64)), axis=0), axis=1).astype(np.uint8)
    images = [x.tobytes() for x in (ramp, noise, smooth, np.zeros((5, 64), np.uint8), noise[:1], ramp[7:9])]
    stored = [media.png_encode(x) for x in images]
    assert {k for x in stored for k in media.png_lines(x)[0].tolist()} == {0, 1, 2, 3, 4}
    monkeypatch.setattr(media, "FILTER_ROWS", 7)  # blocks change nothing
    assert [media.png_encode(x) for x in images] == stored
    for rows in (1, 60, 1 << 14):
        monkeypatch.setattr(media, "GROUP_ROWS", rows)
        assert {n: (x.tobytes(), own) for n, x, own in media.png_decode_all(stored)} == {n: (x, len(x)) for n, x in enumerate(images)}
    narrow = rng.integers(0, 256, (9, 1), dtype=np.uint8)
    kinds, told = media.filter_rows(narrow)
    assert (media.unfilter(kinds, told) == narrow).all()
    with pytest.raises(ValueError):
        media.unfilter(np.array([5], np.uint8), noise[:1])
    assert list(media.png_decode_all([])) == []
