"""Columns of whole numbers as small binary values, for what one block of texts sends through a shuffle."""

from __future__ import annotations

import zlib

import numpy as np


def packed(n: np.ndarray) -> bytes:
    """Non-negative whole numbers in the narrowest width that holds them, byte by byte, deflated."""
    top = int(n.max()) if n.size else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = n.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(raw[0], -1).T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def packed_ascending(n: np.ndarray) -> bytes:
    """Ascending numbers as differences."""
    return packed(np.diff(n, prepend=0))


def unpacked_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))
