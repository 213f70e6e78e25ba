"""Byte codecs of the container's sections: CBOR, PNG, raw deflate. Small pure helpers for Arrow tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def to_cbor(value) -> bytes:
    """CBOR of None, booleans, whole numbers, floats, texts, bytes, lists and maps (in their order)."""

    def head(major: int, n: int) -> bytes:
        if n < 24:
            return bytes((major << 5 | n,))
        for code, kind, limit in ((24, "B", 1 << 8), (25, "H", 1 << 16), (26, "I", 1 << 32), (27, "Q", 1 << 64)):
            if n < limit:
                return bytes((major << 5 | code,)) + struct.pack(f">{kind}", n)
        raise ValueError("number too large")

    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        body = value.encode()
        return head(3, len(body)) + body
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(to_cbor(x) for item in value.items() for x in item)
    return head(4, len(value)) + b"".join(map(to_cbor, value))


def from_cbor(data: bytes):
    """The value of a CBOR item; ValueError for damage, bytes left over among it."""

    def take(at: int, n: int) -> tuple[bytes, int]:
        if at + n > len(data):
            raise ValueError("CBOR ends early")
        return data[at : at + n], at + n

    def item(at: int):
        first, at = take(at, 1)
        major, n = first[0] >> 5, first[0] & 31
        if major == 7:
            if n in (20, 21, 22, 23):
                return (False, True, None, None)[n - 20], at
            if n in (25, 26, 27):
                kind, size = {25: ("e", 2), 26: ("f", 4), 27: ("d", 8)}[n]
                body, at = take(at, size)
                return struct.unpack(f">{kind}", body)[0], at
            raise ValueError(f"CBOR simple value {n}")
        if n >= 24:
            if n > 27:
                raise ValueError("CBOR length of unknown form")
            body, at = take(at, 1 << (n - 24))
            n = int.from_bytes(body, "big")
        if major == 0:
            return n, at
        if major == 1:
            return -1 - n, at
        if major in (2, 3):
            body, at = take(at, n)
            return (body if major == 2 else body.decode()), at
        if major == 4:
            out = []
            for _ in range(n):
                value, at = item(at)
                out.append(value)
            return out, at
        if major == 5:
            pairs = {}
            for _ in range(n):
                key, at = item(at)
                pairs[key], at = item(at)
            return pairs, at
        raise ValueError("CBOR tags are not supported")

    value, end = item(0)
    if end != len(data):
        raise ValueError("bytes after the CBOR item")
    return value


def deflate(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


# The PNG signature.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_png(image: np.ndarray) -> bytes:
    """A (height, width, 4) uint8 image as PNG."""
    height, width, _ = image.shape
    rows = np.zeros((height, 1 + 4 * width), dtype=np.uint8)
    rows[:, 1:] = image.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The (height, width, 4) image of an 8-bit RGBA or RGB PNG without interlacing; ValueError for others and damage."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("PNG chunk is damaged")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("PNG of an unsupported form")
    width, height, step = head[0], head[1], 4 if head[3] == 6 else 3
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + step * width)
    out = np.zeros((height, step * width), dtype=np.uint8)
    above = np.zeros(step * width, dtype=np.uint8)
    for y in range(height):
        out[y] = above = unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    image = out.reshape(height, width, step)
    return image if step == 4 else np.concatenate((image, np.full((height, width, 1), 255, dtype=np.uint8)), axis=2)


def unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out = row.astype(int).tolist()
    up = above.tolist()
    for i, value in enumerate(out):
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        b = up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((a, b, c), key=lambda x: abs(p - x))
        out[i] = (value + guess) & 255
    return np.array(out, dtype=np.uint8)
