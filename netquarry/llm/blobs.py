"""Integer arrays as compact bytes, for rows that carry thousands of keys each."""

from __future__ import annotations

import numpy as np


def pack(x: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of each number, byte by byte: planes of zeros shrink to nothing under any block compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray, width: int = 8) -> bytes:
    """Ascending numbers as differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)), width)


def unpack_sorted(data: bytes, width: int = 8) -> np.ndarray:
    return np.cumsum(unpack(data, width), dtype=np.uint64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins, and the length at the end."""
    return np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))), [len(x)]))


def bundle(*arrays: np.ndarray) -> bytes:
    """Several arrays of non-negative integers, each in as many bytes as its largest number needs."""
    out = []
    for x in arrays:
        x = np.asarray(x).astype(np.uint64)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [len(x).to_bytes(7, "little") + bytes([width]), pack(x, width)]
    return b"".join(out)


def unbundle(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 7], "little"), data[at + 7]
        out.append(unpack(data[at + 8 : at + 8 + n * width], width))
        at += 8 + n * width
    return out
