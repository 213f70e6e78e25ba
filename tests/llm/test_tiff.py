import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import tiff as T


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([T.NONE, T.PACKBITS, T.LZW, T.DEFLATE]))
def test_codecs_round_trip(data, method):
    assert T.decode(T.encode(data, method), method, len(data)) == data


def test_long_lzw_resets_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 20_000
    assert T.lzw_decode(T.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("method", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_pages_round_trip(method, predictor, tile):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 256, (37, 21)).astype(np.uint8), rng.integers(0, 256, (5, 64, 3)).astype(np.uint8), np.zeros((1, 1), dtype=np.uint8)]
    rows = list(T.read_tiff(T.write_tiff(pages, method, predictor, 8, tile)))
    assert [r[0] for r in rows] == [0, 1, 2] and all(r[-1] is None for r in rows)
    for page, row in zip(pages, rows):
        assert row[7] == page.tobytes() and (row[2], row[1]) == page.shape[:2]


def test_big_endian_16_bits():
    values = (np.arange(6).reshape(2, 3) * 300).astype(">u2")
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, 12)]
    body = b"MM\0*" + struct.pack(">I", 20) + values.tobytes()
    entries = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags)
    (row,) = T.read_tiff(body + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0")
    assert np.frombuffer(row[7], dtype=np.uint16).tolist() == values.ravel().tolist()


def test_damage_is_a_row(spark):
    good = T.write_tiff([np.arange(256, dtype=np.uint8).reshape(16, 16)])
    files = [(1, good, "x"), (2, b"", "x"), (3, b"II*\0\xff\xff\xff\xff", "x"), (4, good[:60], "x"), (5, None, "x"), (1, good, "x"), (6, good[:8] + b"\0" * 20 + good[28:], "x")]
    df = spark.createDataFrame(files, "page_id long, media binary, extra string")
    rows = T.tiff_pages(df, "media", ["page_id"]).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 2, 3, 4, 6]
    assert all((r.error is None) == (r.page_id == 1) for r in rows)
    assert T.tiff_pages(df.where("page_id > 9"), "media", ["page_id"]).count() == 0


def test_a_chain_of_directories_that_turns_back_ends():
    data = bytearray(T.write_tiff([np.zeros((2, 2), dtype=np.uint8)]))
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    struct.pack_into("<I", data, at + 2 + 12 * n, at)
    assert len(list(T.read_tiff(bytes(data)))) == 1


def file_of(tags, body=b"", order="<"):
    """A file with one directory of (tag, kind, values) and ``body`` at its byte 8."""
    data = (b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0" + body
    entries = b""
    for tag, kind, values in sorted(tags):
        packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            at, data = len(data), data + packed
            packed = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    at = len(data)
    return data[:4] + struct.pack(order + "I", at) + data[8:] + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"


def page_tags(width, height, bits, body, *more, rows=None):
    own = {t for t, _, _ in more}
    return [x for x in [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [1]), (273, 4, [8]), (277, 3, [1]), (278, 4, [rows or max(height, 1)]), (279, 4, [len(body)])] if x[0] not in own] + list(more)


@pytest.mark.parametrize("width, height", [(0, 4), (4, 0), (2**31, 2**31), (2**32 - 1, 1), (65536, 65536)])
def test_forged_sizes_are_errors(width, height):
    for method in (1, 5, 8, 32773):
        (row,) = T.read_tiff(file_of(page_tags(width, height, 8, b"abcd", (259, 3, [method])), b"abcd"))
        assert row[7] is None and row[8]


def test_damage_anywhere_never_raises():
    rng = np.random.default_rng(4)
    good = [T.write_tiff([rng.integers(0, 256, (20, 33)).astype(np.uint8)], m, 2, 7, t) for m in (1, 5, 8, 32773) for t in (None, 16)]
    for data in good:
        for _ in range(150):
            bad = bytearray(data)
            for at in rng.integers(0, len(bad), 3):
                bad[at] = rng.integers(0, 256)
            rows = list(T.read_tiff(bytes(bad[: rng.integers(1, len(bad) + 1)])))
            assert all((r[7] is None) == (r[8] is not None) for r in rows)


def test_few_bits_planes_and_floats():
    body = bytes([0b10110000, 0b01000000])
    (row,) = T.read_tiff(file_of(page_tags(3, 2, 1, body), body))
    assert row[4] == 1 and list(row[7]) == [1, 0, 1, 0, 1, 0]
    body = bytes([0x12, 0x30])
    (row,) = T.read_tiff(file_of(page_tags(3, 1, 4, body), body))
    assert list(row[7]) == [1, 2, 3]
    body = bytes(range(8))
    (row,) = T.read_tiff(file_of(page_tags(2, 2, 8, body, (258, 3, [8, 8]), (277, 3, [2]), (284, 3, [2]), (273, 4, [8, 12]), (279, 4, [4, 4])), body))
    assert list(row[7]) == [0, 4, 1, 5, 2, 6, 3, 7]
    values = np.array([[1.5, -2.25, 1e6], [0.0, 3.0, 7.5]], dtype=">f4")
    planes = values.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    body = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    for order in "<>":
        (row,) = T.read_tiff(file_of(page_tags(3, 2, 32, body, (339, 3, [3]), (317, 3, [3])), body, order))
        assert row[8] is None and np.frombuffer(row[7], np.float32).tolist() == values.ravel().tolist()
