"""Baseline JPEG from arrays: all blocks of an image at once, with Huffman codes made for each image.

Colours become luma and two chroma planes at full size; each plane is cut in blocks of 8 x 8, transformed, divided by the table of its
quality and coded as runs of zeros and values.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the standard (its annex K.1): steps of luma and chroma at quality 50, by rows.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)
#: From red, green, blue to luma and chroma around 128.
PLANES = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
LONGEST = 16


def zigzag() -> np.ndarray:
    """Places of a block (8 * row + column) in the order of its diagonals, which turn at each end."""
    y, x = np.divmod(np.arange(64), 8)
    along = np.where((x + y) % 2 == 0, x, y)
    return np.lexsort((along, x + y))


def steps(table: tuple[int, ...], quality: int) -> np.ndarray:
    """The table of a quality from 1 to 100."""
    share = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * share + 50) // 100, 1, 255)


def cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def blocks(plane: np.ndarray) -> np.ndarray:
    """(blocks x 8 x 8) in rows of blocks; the last pixels go on to whole blocks."""
    height, width = plane.shape
    wide = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
    return wide.reshape(wide.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(np.abs(values), 1))) + 1).astype(np.int64)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths, ``LONGEST`` at most, of a prefix code for the symbols with counts; the code of ones only stays free.

    Packages of symbols are merged once for each bit of the longest length; the cheapest ones make up the code.
    """
    symbols = [(int(n), (s,)) for s, n in enumerate(counts) if n] + [(0, (-1,))]  # -1 takes the code of ones
    row = sorted(symbols)
    for _ in range(LONGEST - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(symbols + pairs)
    lengths: dict[int, int] = {}
    for _, held in row[: 2 * len(symbols) - 2]:
        for s in held:
            lengths[s] = lengths.get(s, 0) + 1
    # The longest code belongs to -1, which is never written.
    longest = max(lengths, key=lambda s: (lengths[s], s == -1))
    lengths[-1], lengths[longest] = lengths[longest], lengths[-1]
    del lengths[-1]
    return lengths


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the table as a file has it, codes and lengths by symbol)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    code = before = 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], sizes[s] = code, before
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, LONGEST + 1)) + bytes(order), codes, sizes


def symbols_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, order in the block, symbol, value) of everything that is coded of blocks of zigzagged values, in order; order 0 is the difference of the first values."""
    n = len(flat)
    first = np.diff(flat[:, 0], prepend=0)
    block, place = np.nonzero(flat[:, 1:])
    place = place + 1
    value = flat[block, place]
    same = np.append(False, block[1:] == block[:-1]) if len(block) else np.zeros(0, dtype=bool)
    run = place - np.where(same, np.append(0, place[:-1]) if len(place) else place, 0) - 1
    # Sixteen zeros are a symbol of their own; what follows them has what is left of the run.
    long = run // 16
    skip_block, skip_place = np.repeat(block, long), np.repeat(place, long)
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    parts = [
        (np.arange(n), np.zeros(n, dtype=np.int64), bit_lengths(first), first),
        (skip_block, 3 * skip_place, np.full(len(skip_block), 0xF0), np.zeros(len(skip_block), dtype=np.int64)),
        (block, 3 * place + 1, run % 16 * 16 + bit_lengths(value), value),
        (ends, np.full(len(ends), 3 * 64), np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64)),
    ]
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The lowest ``sizes`` bits of each value one after the other, filled up with ones; a byte of ones is followed by zeros."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.ones(-(-total // 8) * 8, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        bits[ends[own] - 1 - k] = values[own] >> k & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def to_jpeg(image: np.ndarray, quality: int = 85) -> bytes:
    """A (height, width, 3 or 4) uint8 image as a baseline JPEG; a fourth channel is left out, as the format has none."""
    height, width, _ = image.shape
    if not (0 < height < 65536 and 0 < width < 65536 and 1 <= quality <= 100):
        raise ValueError("sides from 1 to 65535 and a quality from 1 to 100")
    planes = image[:, :, :3].astype(np.float64) @ PLANES.T - np.array([128.0, 0.0, 0.0])
    order, turn = zigzag(), cosines()
    tables = [steps(LUMA_STEPS, quality), steps(CHROMA_STEPS, quality)]
    coded = []
    for k in range(3):
        cells = turn @ blocks(planes[:, :, k]) @ turn.T
        flat = np.rint(cells.reshape(-1, 64) / tables[min(k, 1)]).astype(np.int64)[:, order]
        coded.append(symbols_of(flat))
    # Luma has a pair of code tables of its own, the chroma planes share one.
    segments, found = [], {}
    for which, group in ((0, coded[:1]), (1, coded[1:])):
        place, symbol = (np.concatenate([c[i] for c in group]) for i in (1, 2))
        for kind, own in ((0, place == 0), (1, place > 0)):
            body, codes, sizes = canonical(code_lengths(np.bincount(symbol[own], minlength=256)))
            found[which, kind] = codes, sizes
            segments.append(bytes([kind << 4 | which]) + body)
    # Interleaved: the blocks of the three planes at a place follow each other.
    columns = []
    for k, (block, place, symbol, value) in enumerate(coded):
        kind = (place > 0).astype(np.int64)
        codes, sizes = (np.stack([found[min(k, 1), j][i] for j in (0, 1)]) for i in (0, 1))
        n = symbol & 15
        extra = np.where(value < 0, value + (1 << n) - 1, value)
        columns.append((block, np.full(len(block), k), place, codes[kind, symbol] << n | extra, sizes[kind, symbol] + n))
    block, plane, place, values, sizes = (np.concatenate(c) for c in zip(*columns))
    turn_of = np.lexsort((place, plane, block))
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([k]) + bytes(t[order].tolist())) for k, t in enumerate(tables)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(3))))
    out += [segment(0xC4, s) for s in segments]
    out.append(segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join(out) + packed(values[turn_of], sizes[turn_of]) + b"\xff\xd9"
