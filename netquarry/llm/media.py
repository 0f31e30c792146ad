"""Media columns: payloads in PNG images held in binary columns, and perceptual hashes of what is read back.

A payload becomes an 8-bit grey image 64 samples wide: IHDR, a private chunk with the payload's own length, zlib data in
IDAT chunks and IEND, each with its CRC-32. Each row is written with that of the five filters whose bytes, as signed numbers, have the least sum
of magnitudes. Reading tests signature, chunk order, lengths and checksums, inflates, and undoes the filters with numpy, diagonal by diagonal of
many images at once. The hash is the sign pattern of the 63 lowest cosine coefficients but the
constant one, of the image's mean values on a 32 x 32 grid.

Defined cases: a null payload is empty; an empty one is one row of zeros. A broken image raises ValueError. Long payloads are
stored whole (one image, several IDAT chunks). Equal payloads give equal bytes and hashes. No row is dropped or repeated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

WIDTH = 64
LEVEL = 1
IDAT_BYTES = 1 << 16
FILTER_ROWS, GROUP_ROWS = 1 << 12, 1 << 14
GRID, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
OWN_LENGTH = b"nqLn"  # ancillary, private, safe to copy

_k = np.arange(LOW)[:, None]
_COSINES = np.cos(np.pi * (2 * np.arange(GRID)[None, :] + 1) * _k / (2 * GRID)) * np.where(_k == 0, np.sqrt(1 / GRID), np.sqrt(2 / GRID))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + up - corner; the first of these on ties."""
    a, b = np.abs(up - corner), np.abs(left - corner)
    c = np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filter_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, filtered rows) of 8-bit grey rows: of each row the filter with the least sum of magnitudes, the first on ties."""
    kinds, out = np.zeros(len(rows), np.uint8), np.empty_like(rows)
    for at in range(0, len(rows), FILTER_ROWS):  # bounded memory for long images
        own = rows[at : at + FILTER_ROWS]
        n, width = own.shape
        edged = np.zeros((n + 1, width + 1), np.int16)
        edged[1:, 1:] = own
        if at:
            edged[0, 1:] = rows[at - 1]
        x, left, up, corner = edged[1:, 1:], edged[1:, :-1], edged[:-1, 1:], edged[:-1, :-1]
        best = np.full(n, np.iinfo(np.int64).max)
        for kind, guess in enumerate((0, left, up, (left + up) >> 1, _paeth(left, up, corner))):
            told = (x - guess).astype(np.uint8)
            cost = np.abs(told.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            better = cost < best
            best[better], kinds[at : at + n][better], out[at : at + n][better] = cost[better], kind, told[better]
    return kinds, out


def png_encode(payload: bytes, level: int = LEVEL) -> bytes:
    """The payload, zeros up to a positive multiple of 64 appended, as a PNG."""
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    rows = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = filter_rows(rows)
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(OWN_LENGTH, struct.pack(">Q", len(payload))) + b"".join(parts) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk, checksums tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            if at != len(data):
                raise ValueError("data after IEND")
            return
    raise ValueError("no IEND")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters of one image."""
    return unfilter_all([(kinds, rows)])[0]


def unfilter_all(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Undoes PNG's row filters of 8-bit grey images (kinds, rows) of one width. A sample needs those to the left and above, so all samples of a diagonal are undone at
    once, of all images together; lower images are filled up with rows of zeros."""
    height, width = max(len(k) for k, _ in images), images[0][1].shape[1]
    lines, of = np.zeros((height, width, len(images)), np.uint8), np.zeros((height, len(images)), np.uint8)
    for n, (kinds, rows) in enumerate(images):
        if len(kinds) and kinds.max() > 4:
            raise ValueError(f"filter {kinds.max()}")
        lines[: len(rows), :, n], of[: len(kinds), n] = rows, kinds
    out = np.zeros((height + 1, width + 1, len(images)), np.uint8)
    flat, told = out.reshape(-1, len(images)), lines.reshape(-1, len(images))
    for d in range(height + width - 1):
        low, high = max(0, d - width + 1), min(height - 1, d)  # the diagonal's rows; it is a slice of the flat arrays
        on = lambda edge: flat[low * width + d + edge : high * width + d + edge + 1 : width]  # noqa: B023, E731
        left, up, corner = (on(edge).astype(np.int16) for edge in (width + 1, 1, 0))
        guess = np.choose(of[low : high + 1], (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
        step = max(1, width - 1)
        on(width + 2)[:] = told[low * (width - 1) + d : high * (width - 1) + d + 1 : step] + guess.astype(np.uint8)
    return [np.ascontiguousarray(out[1 : len(kinds) + 1, 1:, n]) for n, (kinds, _) in enumerate(images)]


def png_lines(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(filter kinds, filtered rows, the payload's own length (all samples, where the private chunk is missing)) of an image."""
    chunks = list(png_chunks(data))
    if chunks[0][0] != b"IHDR" or len(chunks[0][1]) != 13:
        raise ValueError("no IHDR")
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    if (depth, colour, rest) != (8, 0, [0, 0, 0]) or not width or not height:
        raise ValueError("not an 8-bit grey image without interlace")
    own = [x for kind, x in chunks if kind == OWN_LENGTH]
    size = height * (width + 1)
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(x for kind, x in chunks if kind == b"IDAT"), size + 1)
    if len(raw) != size or not inflate.eof:
        raise ValueError("image data of another length than IHDR says")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return lines[:, 0], lines[:, 1:], struct.unpack(">Q", own[0])[0] if own else width * height


def png_decode(data: bytes) -> tuple[np.ndarray, int]:
    """The image's samples and the payload's own length."""
    kinds, rows, own = png_lines(data)
    return unfilter(kinds, rows), own


def png_decode_all(media: list[bytes]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(position, samples, own length) of each image, not in order: images of one width and like height are undone together, GROUP_ROWS rows at a time (or one longer image)."""
    waiting: list[tuple[int, int, int]] = []
    for n, data in enumerate(media):
        if len(data) < 33:
            raise ValueError("no IHDR")
        waiting.append((*struct.unpack_from(">II", data, 16), n))
    waiting.sort()
    at = 0
    while at < len(waiting):
        width, to = waiting[at][0], at + 1
        while to < len(waiting) and waiting[to][0] == width and (to + 1 - at) * waiting[to][1] <= GROUP_ROWS:
            to += 1
        group = [(n, *png_lines(media[n])) for _, _, n in waiting[at:to]]
        for (n, _, _, own), image in zip(group, unfilter_all([(k, r) for _, k, r, _ in group]), strict=True):
            yield n, image, own
        at = to


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the 32 bands of n lines begins, and how many lines it has (one at least)."""
    at = np.arange(GRID + 1) * n // GRID
    return at[:-1], np.maximum(np.diff(at), 1)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits; the first bit, of the constant coefficient, is 0."""
    sums = np.concatenate((np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)))
    a, n = _grid(image.shape[0])
    bands = (sums[a + n] - sums[a]) / n[:, None]
    sums = np.concatenate((np.zeros((GRID, 1)), np.cumsum(bands, axis=1)), axis=1)
    a, n = _grid(image.shape[1])
    low = np.round(_COSINES @ ((sums[:, a + n] - sums[:, a]) / n) @ _COSINES.T, 4).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


@F.pandas_udf(T.BinaryType())
def encode_png(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in payloads:
        yield pd.Series([png_encode(x if isinstance(x, bytes) else b"") for x in batch], dtype=object)


_READ = T.StructType([T.StructField(c, T.StringType() if c in ("payload_sha256", "feature") else T.LongType()) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "n_bytes", "feature")])


@F.pandas_udf(_READ)
def read_png(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in media:
        media_, rows = list(batch), [None] * len(batch)
        for n, image, own in png_decode_all(media_):
            payload = image.tobytes()
            rows[n] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), own, cosine_hash(image))
        yield pd.DataFrame(rows, columns=_READ.names)


@F.pandas_udf(T.BinaryType())
def decode_png(media: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The payloads, without what was appended."""
    for batch in media:
        media_, found = list(batch), [b""] * len(batch)
        for n, image, own in png_decode_all(media_):
            found[n] = image.tobytes()[:own]
        yield pd.Series(found, dtype=object)


def with_media(df: DataFrame, payload: Column, name: str = "media") -> DataFrame:
    """Adds the payload (binary, null as empty) as a PNG column."""
    return df.withColumn(name, encode_png(F.coalesce(payload, F.lit(b""))))


def with_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the stored images say: payload_bytes, payload_sha256, tail_crc32, n_bytes, feature."""
    return df.withColumn("_read", read_png(F.col(media))).withColumns({c: F.col(f"_read.{c}") for c in _READ.names}).drop("_read")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    media = with_media(docs, F.col("payload")).drop("payload")
    return with_features(media).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
