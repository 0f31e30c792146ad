"""Word hashing shared by the corpus operators: whole texts to 64-bit word and shingle keys with numpy.

A batch of texts becomes one byte buffer. Words are the runs of bytes for which a 256-entry table is
true; each word's key is a polynomial hash of its bytes (prefix sums over powers of an odd base, so no
Python loop runs over words), finished with a bijective 64-bit mix. Keys depend on the bytes alone, so
every executor computes the same keys.

Nulls are empty texts. Texts of any length are hashed whole. Two different words share a key with a
chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the contracts: anything but ASCII white space; ASCII digits, letters and all non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

_PIECE = 1 << 21
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, _PIECE + 64), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = _LETTERS[data]
    terms *= power[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_keys(texts: list[bytes], table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts, and where each text's words begin (one more entry than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = table[data]
    inside[np.cumsum(sizes + 1) - 1] = False  # the joints
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside))))
    starts, ends = edges[0::2], edges[1::2]
    keys = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # a few MB of bytes at a time, at word bounds
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _PIECE, "right")))
        keys[a:b] = _hashed(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return keys, np.concatenate(([0], np.searchsorted(starts, np.cumsum(sizes + 1), "left")))


def shingle_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-word shingles of one text; a shorter text's whole sequence is one shingle, no words give none."""
    n = min(n, len(keys))
    if n == 0:
        return keys
    total = np.full(len(keys) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + keys[i : len(keys) - n + 1 + i]
    return mix(total)


def shingle_sets(texts: list[bytes], n: int = 5, table: np.ndarray = NOT_SPACE):
    """The sorted distinct shingle keys of each text."""
    keys, at = word_keys(texts, table)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(shingle_keys(keys[a:b], n))


def chunks(texts: list[bytes], most: int = 2_000_000):
    """Slices of the list that hold about so many bytes each, so that the arrays above stay small."""
    a = size = 0
    for b, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(a, b)
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield slice(a, len(texts))


def encoded(column) -> list[bytes]:
    """A pandas column of texts as UTF-8, nulls empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]
