"""Small pictures as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def grey(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> bytes:
    """A picture of grey and alpha from cells; those without a value (NaN), or without a cell, are transparent."""
    high, wide = int(rows.max()) + 1, int(cols.max()) + 1
    picture = np.zeros((high, wide, 2), np.uint8)
    seen = ~np.isnan(values.astype(float))
    picture[rows[seen], cols[seen]] = np.stack([values[seen].astype(np.uint8), np.full(int(seen.sum()), 255, np.uint8)], axis=1)
    lines = b"".join(b"\0" + line.tobytes() for line in picture)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
