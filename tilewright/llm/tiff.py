"""TIFF columns: a writer for lossless 8-bit pages and a reader that emits one row per page.

The reader walks the image file directories of little- and big-endian files, takes strips or tiles, interleaved
or in planes, undoes PackBits, LZW or deflate and the horizontal or floating-point predictor, and returns whole or
floating-point samples. Damaged files give one row with an error instead of a failed job: what a page claims to
hold is compared with what its stored bytes can unfold to before any memory is taken.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: tags, compression schemes, bytes per field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS = 256, 257, 258, 259, 262, 273
SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Runs that PackBits shortens.
RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)
#: How many bytes a stored byte unfolds to at most, by scheme.
UNFOLDS = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: A cell of a table holds no more.
MOST_BYTES = (1 << 31) - 1

PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for run in RUNS.finditer(data):
        for i in range(at, run.start(), 128):
            part = data[i : min(i + 128, run.start())]
            out.append(len(part) - 1)
            out += part
        at = run.end()
        out += bytes((257 - (at - run.start()), data[run.start()]))
    for i in range(at, len(data), 128):
        part = data[i : i + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def code_widths(first: int, n: int) -> np.ndarray:
    """Bits of the LZW codes ``first``, ``first + 1`` ... after a clear code."""
    return np.searchsorted(np.array([512, 1024, 2048]), np.arange(258 + first, 258 + first + n), side="right") + 9


def lzw_encode(data: bytes) -> bytes:
    codes, table, following, now = [CLEAR], {}, 258, -1
    for b in data:
        if now < 0:
            now = b
            continue
        key = now << 8 | b
        longer = table.get(key)
        if longer is not None:
            now = longer
            continue
        codes.append(now)
        table[key] = following
        following += 1
        if following == 4095:
            codes.append(CLEAR)
            table, following = {}, 258
        now = b
    if now >= 0:
        codes.append(now)
    codes.append(END)
    # Between two clear codes stand 4095 - 258 others, so the places of all are known.
    per = 4095 - 258 + 1
    widths = np.append(9, code_widths(0, per)[np.arange(len(codes) - 1) % per])
    bits = np.unpackbits(np.array(codes, dtype=">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    padded, end = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32), 8 * len(data)
    parts, length, bit, k, table, before = [], 0, 0, 0, first[:], b""
    while length < size:
        widths = code_widths(k, min(4096, (end - bit) // 9 + 1))
        starts = bit + np.cumsum(widths) - widths
        widths = widths[starts + widths <= end]
        starts = starts[: len(widths)]
        if not len(widths):
            break
        at = starts >> 3
        codes = (padded[at] << 16 | padded[at + 1] << 8 | padded[at + 2]) >> (24 - (starts & 7) - widths).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise ValueError("an LZW code before its entry")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            parts.append(entry)
            length += len(entry)
            before = entry
        if stop == len(codes):
            bit, k = int(starts[-1] + widths[-1]), k + len(codes)
        elif codes[stop] == END:
            break
        else:
            bit, k, table, before = int(starts[stop] + widths[stop]), 0, first[:], b""
    return b"".join(parts)


def encode(data: bytes, method: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}[method](data)


def decode(data: bytes, method: int, size: int) -> bytes:
    if method == NONE:
        return bytes(data)
    if method in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if method == LZW:
        return lzw_decode(data, size)
    if method == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {method}")


def predict(rows: np.ndarray) -> np.ndarray:
    """Horizontal differences along axis 1."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def write_tiff(pages: list[np.ndarray], method: int = DEFLATE, predictor: int = 2, strip_rows: int = 1024, tile: int | None = None) -> bytes:
    """A little-endian file with one directory for each (height, width) or (height, width, samples) page of 8 bits.

    Strips have ``strip_rows`` rows; with ``tile`` (a multiple of 16) square tiles are written instead.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        cube = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = cube.shape
        if tile:
            padded = np.pad(cube, ((0, -height % tile), (0, -width % tile), (0, 0)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [cube[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for part in parts:
            body = encode((predict(part) if predictor == 2 else part).tobytes(), method)
            offsets.append(len(out))
            counts.append(len(body))
            out += body + b"\0" * (len(body) % 2)
        kinds = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        fields = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [method]), PHOTOMETRIC: (3, [2 if samples >= 3 else 1]),
            SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]), kinds[0]: (4, offsets), kinds[1]: (4, counts),
        }
        fields |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile])} if tile else {ROWS_PER_STRIP: (4, [strip_rows])}
        entries = bytearray()
        for tag in sorted(fields):
            kind, values = fields[tag]
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """(byte order, tag values) of each image directory; stops at a directory that was seen before."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_BYTES.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if size > len(data):
                raise ValueError(f"tag {tag} of {count} values")
            if kind in (1, 3, 4):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def samples_of(raw: bytes, rows: int, columns: int, samples: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """(rows x columns x samples) of one strip or tile, its predictor undone."""
    if bits < 8:  # rows begin at whole bytes
        line = -(-columns * samples * bits // 8)
        flat = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)
        flat = flat[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
        return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    if predictor == 3:  # differences of bytes, the highest bytes of a row first
        size = kind.itemsize
        flat = np.frombuffer(raw, np.uint8, rows * columns * samples * size).reshape(rows, columns * size, samples)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, samples).astype(kind.newbyteorder("="))
    part = np.frombuffer(raw, kind, rows * columns * samples).reshape(rows, columns, samples).astype(kind.newbyteorder("="))
    return np.cumsum(part, axis=1, dtype=part.dtype) if predictor == 2 else part


def read_page(data: bytes, order: str, tags: dict[int, list[int]]) -> tuple[np.ndarray, int, int, int]:
    """(height x width x samples array, bits, compression, predictor)."""
    one = lambda tag, otherwise: tags.get(tag, [otherwise])[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    method, predictor, planar, form = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    depths = set(tags.get(BITS, [1]))
    bits = depths.pop()
    held = {1: "u", 2: "i", 3: "f"}.get(form)
    if depths or held is None or bits not in ((32, 64) if form == 3 else (1, 2, 4, 8, 16, 32, 64)) or planar not in (1, 2) or method not in UNFOLDS:
        raise ValueError(f"{sorted({bits, *depths})} bits of form {form}, planar {planar}, compression {method}")
    if predictor not in ((1, 3) if form == 3 else (1, 2)) or predictor > 1 and bits < 8:
        raise ValueError(f"predictor {predictor} of {bits} bits of form {form}")
    kind = np.dtype(f"{order}{held}{max(bits // 8, 1)}")
    tiled = TILE_OFFSETS in tags
    part_w = tags[TILE_WIDTH][0] if tiled else width
    part_h = tags[TILE_HEIGHT][0] if tiled else min(one(ROWS_PER_STRIP, height), height)
    if min(width, height, samples, part_w, part_h) < 1:
        raise ValueError(f"a page of {width} x {height} x {samples} in parts of {part_w} x {part_h}")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // part_w), -(-height // part_h)
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} parts, {len(counts)} sizes, {across * down * planes} wanted")
    if any(at + count > len(data) for at, count in zip(offsets, counts)):
        raise ValueError("a part beyond the end")
    total = width * height * samples * kind.itemsize
    stored = UNFOLDS[method] * sum(counts)
    if total > MOST_BYTES or -(-part_w * deep * bits // 8) * part_h > MOST_BYTES or width * height * samples * bits > 8 * stored:
        raise ValueError(f"{total} bytes from {sum(counts)}")
    image = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k, (at, count) in enumerate(zip(offsets, counts)):
        plane, k = divmod(k, across * down)
        y, x = k // across * part_h, k % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        size = rows * -(-part_w * deep * bits // 8)
        if size > UNFOLDS[method] * count:
            raise ValueError(f"part {k} has {count} stored bytes for {size}")
        raw = decode(data[at : at + count], method, size)
        if len(raw) < size:
            raise ValueError(f"part {k} has {len(raw)} of {size} bytes")
        part = samples_of(raw, rows, part_w, deep, bits, kind, predictor)[: height - y, : width - x]
        if planar == 2:
            image[y : y + rows, x : x + part_w, plane] = part[:, :, 0]
        else:
            image[y : y + rows, x : x + part_w] = part
    return image, bits, method, predictor


def read_tiff(data: bytes | None) -> Iterator[tuple]:
    """Rows of ``PAGES``. A null column gives none, damage one row that holds the error."""
    if data is None:
        return
    page = 0
    try:
        for order, tags in directories(data):
            image, bits, method, predictor = read_page(data, order, tags)
            yield page, image.shape[1], image.shape[0], image.shape[2], bits, method, predictor, image.tobytes(), None
            page += 1
    except (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        yield page, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def tiff_pages(files: DataFrame, column: str, keep: list[str], measure: Callable[[bytes], tuple] | None = None, measures: str = "pixels binary") -> DataFrame:
    """One row per page of the TIFF files in ``column``: the columns ``keep``, then those of ``PAGES``.

    With ``measure`` the samples stay in the task that decodes them, and what it returns for them (columns
    ``measures``, null for damaged pages) takes their place. Null files give no row, empty and damaged ones a
    row with an error; repeated rows are read each. Samples are in native byte order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    chosen = files.select(*keep, column)
    page, made = _parse_datatype_string(PAGES).fields, _parse_datatype_string(measures).fields
    extra = StructType([*page[:-2], *made, page[-1]])
    schema = StructType([*chosen.schema.fields[:-1], *extra.fields])
    kinds = list(to_arrow_schema(extra).types)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows, out = [], [[] for _ in kinds]
                for k in range(i, min(i + 256, batch.num_rows)):
                    for page in read_tiff(batch.column(len(keep))[k].as_py()):
                        rows.append(k)
                        pixels = page[-2]
                        found = (pixels,) if measure is None else (None,) * len(made) if pixels is None else measure(pixels)
                        for values, value in zip(out, (*page[:-2], *found, page[-1])):
                            values.append(value)
                left = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(left + [pa.array(v, t) for v, t in zip(out, kinds)], schema.names)

    return chosen.mapInArrow(pages, schema)
