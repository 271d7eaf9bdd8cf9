"""Numpy arrays as one compressed value, for what moves in few large rows."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *dtypes: str) -> list[np.ndarray]:
    """The arrays, which have these types."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(plain, "<u8", len(dtypes)).tolist()
    out, at = [], 8 * len(dtypes)
    for size, dtype in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(plain, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out
