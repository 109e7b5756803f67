"""Runs of numbers as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of equal rank together, compressed; of ascending values the differences."""
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(packed: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    values = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values
