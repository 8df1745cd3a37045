"""Image bytes to RGB arrays: PNG here, JPEG and WebP by Pillow where it is installed."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np

from ..errors import DecodeError

#: A decoder gives RGB [height, width, 3] as uint8, or raises a DecodeError.
Decoder = Callable[[bytes], np.ndarray]

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the color type of the header (gray, RGB, palette, gray and alpha, RGBA).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values: (first column, first row, column step, row step) of the seven interlaced passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def image_format(content: bytes) -> str | None:
    """``png``, ``jpeg``, ``webp`` or None, by the first bytes."""
    if content.startswith(_SIGNATURE):
        return "png"
    if content.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    return "webp" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else None


def decode_image(content: bytes) -> np.ndarray:
    """RGB of the image; alpha is dropped, 16 bits are rounded to 8."""
    kind = image_format(content)
    if kind is None:
        raise DecodeError("the image format could not be determined")
    if kind == "png":
        try:
            return _png(content)
        except (struct.error, zlib.error, IndexError, ValueError) as error:
            raise error if isinstance(error, DecodeError) else DecodeError(f"broken png: {error}") from error
    try:
        from PIL import Image
    except ImportError:
        raise DecodeError(f"no decoder for {kind} is installed") from None
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except (OSError, SyntaxError, ValueError) as error:
        raise DecodeError(f"broken {kind}: {error}") from error


def _chunks(content: bytes) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    at = len(_SIGNATURE)
    while b"IEND" not in found:
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != content[at + 8 + size : at + 12 + size]:
            raise DecodeError(f"broken png: checksum of {kind.decode('latin-1')}")
        found[kind] = found.get(kind, b"") + body
        at += 12 + size
    return found


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes with its prediction added; ``step`` is the distance to the pixel before."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        whole = np.zeros(-(-len(line) // step) * step, "u1")
        whole[: len(line)] = line
        return np.cumsum(whole.reshape(-1, step), axis=0, dtype="u1").ravel()[: len(line)]
    out, up = line.tolist(), above.tolist()
    for i, value in enumerate(out):
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        b = up[i]
        if kind == 3:
            guess = (a + b) // 2
        elif kind == 4:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        else:
            raise DecodeError(f"broken png: filter {kind}")
        out[i] = (value + guess) & 255
    return np.array(out, "u1")


def _png(content: bytes) -> np.ndarray:
    parts = _chunks(content)
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if not width or not height or color not in _SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise DecodeError("broken png: header")
    samples = _SAMPLES[color]
    raw = np.frombuffer(zlib.decompress(parts.get(b"IDAT", b"")), "u1")
    step = max(1, samples * depth // 8)
    out = np.zeros((height, width, samples), "u2" if depth == 16 else "u1")
    at = 0
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        size = -(-w * samples * depth // 8)
        above = np.zeros(size, "u1")
        for y in range(h):
            line = raw[at : at + size + 1]
            if len(line) <= size:
                raise DecodeError("broken png: too few pixels")
            above = _unfiltered(int(line[0]), line[1:], above, step)
            at += size + 1
            if depth == 16:
                values = above.view(">u2")
            elif depth == 8:
                values = above
            else:
                bits = np.unpackbits(above).reshape(-1, depth)
                values = bits @ (1 << np.arange(depth)[::-1])
            out[y0 + y * dy, x0::dx] = values[: w * samples].reshape(w, samples)
    if color == 3:
        palette = np.frombuffer(parts[b"PLTE"], "u1").reshape(-1, 3)
        return palette[out[:, :, 0]]
    if depth == 16:
        out = ((out.astype("u4") + 128) // 257).astype("u1")
    elif depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return np.ascontiguousarray(np.repeat(out[:, :, :1], 3, axis=2) if samples < 3 else out[:, :, :3])
