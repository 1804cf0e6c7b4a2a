"""Image bytes to RGB pixels: with an imaging library where one is installed, else PNG and BMP by numpy."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

try:
    from PIL import Image
except ImportError:
    Image = None


def decode_image(content: bytes | None) -> np.ndarray | None:
    """Pixels (height, width, 3) of bytes, transparency dropped; None where the content can't be decoded."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:2] == b"BM":
            return _bmp(content)
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception:  # whatever is wrong with it, it is no image
        return None


def black(size: int) -> np.ndarray:
    return np.zeros((size, size, 3), np.uint8)


def _png(content: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    raw = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = raw[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 16:
        pixels = raw.reshape(height, width, channels, 2)[..., 0]
    elif depth == 8:
        pixels = raw.reshape(height, width, channels)
    else:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)[:, :width]
        value = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)
        pixels = (value if colour == 3 else value * (255 // ((1 << depth) - 1)))[..., None]
    if colour == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if colour in (0, 4) else pixels[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line without its filter: 0 none, 1 left, 2 above, 3 their mean, 4 whichever is nearest to left + above - corner."""
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    columns, up = line.reshape(-1, step), above.reshape(-1, step)
    if kind == 1:
        return columns.cumsum(axis=0, dtype=np.uint8).reshape(-1)
    out, left, corner = [], [0] * step, [0] * step
    for now, over in zip(columns.tolist(), up.tolist()):
        if kind == 3:
            left = [(x + (a + b) // 2) & 255 for x, a, b in zip(now, left, over)]
        elif kind == 4:
            guess = (min((a, b, c), key=lambda v, p=a + b - c: abs(p - v)) for a, b, c in zip(left, over, corner))
            left = [(x + g) & 255 for x, g in zip(now, guess)]
        else:
            raise ValueError(f"filter {kind}")
        corner = over
        out.append(left)
    return np.array(out, np.uint8).reshape(-1)


def _bmp(content: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", content, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", content, 18)
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("not plain")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]
    return pixels[::-1] if height > 0 else pixels
