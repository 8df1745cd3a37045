"""A small PNG writer (8-bit gray, RGB or RGBA), for rendered pages and fixtures."""

from __future__ import annotations

import struct
import zlib

_COLOR = {1: 0, 3: 2, 4: 6}


def encode_png(width: int, height: int, channels: int, data: bytes) -> bytes:
    if len(data) != width * height * channels or channels not in _COLOR:
        raise ValueError("data does not fit the size")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    row = width * channels
    raw = b"".join(b"\0" + data[k * row : (k + 1) * row] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, _COLOR[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
