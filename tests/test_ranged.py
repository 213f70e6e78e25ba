"""Containers read by ranges: equal rows to whole files, and only the bytes that are asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import encoder as E
from tilewright.sources import container as S
from tilewright.sources import images, ranged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files of noise, which does not shrink, and damaged ones."""
    out = tmp_path_factory.mktemp("ranged")
    rng = np.random.default_rng(1)
    pictures = [(k, w, h, np.dstack((rng.integers(0, 256, (h, w, 3)), np.full((h, w), 255))).astype(np.uint8).tobytes()) for k, w, h in ((1, 1024, 768), (2, 100, 300), (3, 64, 64))]
    rows = spark.createDataFrame(pictures, images.RGBA)
    meta = rows.select(F.col("id").alias("file_id"), F.col("width").cast("long"), F.col("height").cast("long"), F.lit(64).cast("long").alias("tile_size"), F.lit(1).alias("max_zoom_level"))
    for r in S.write_files(S.encode_tiles(E.pyramid(rows, 64, 1)), meta).collect():
        (out / f"{r.file_id}.bin").write_bytes(bytes(r.content))
        if r.file_id == 2:
            (out / "cut.bin").write_bytes(bytes(r.content[:-700]))
            (out / "index.bin").write_bytes(bytes(r.content[:44] + (5).to_bytes(4, "little") + r.content[48:]))
    for name, data in (("short", b"abc"), ("magic", b"\0" * 99), ("version", bytes.fromhex(S.MAGIC_HEX) + b"\xff" * 60)):
        (out / f"{name}.bin").write_bytes(data)
    (out / "_ignored").write_bytes(b"x")
    return out


COLUMNS = ["file_id", "level", "x", "y", "offset", "size", "uncompressed_size", "checksum", "payload", "sound"]


@pytest.mark.parametrize("run_bytes", [1 << 30, 100_000, 5_000])
def test_rows_are_those_of_whole_files(spark, folder, run_bytes):
    got = ranged.read_tiles(spark, str(folder), runBytes=run_bytes)
    want = S.payloads(S.sections(S.read_files(spark, str(folder) + "/*.bin")))
    order = lambda df: sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)
    assert order(got.where("error is null")) == order(want) and want.where("not sound").count() > 0
    codes = S.headers(S.read_files(spark, str(folder) + "/*.bin")).select("file_id", S.header_violation().alias("code")).where("code is not null")
    assert order_of(got.where("error is not null").select("file_id", "error")) == order_of(codes)


def order_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("condition", ["level = 1", "level = 0 and x >= 3 and y < 2", "x in (1, 5) and size > 100", "level <= 0 and x > 14 and x <= 15 and sound", "level = 9", "x = 1 or y = 1"])
def test_conditions_are_pushed_down(spark, folder, condition):
    whole = ranged.read_tiles(spark, str(folder))
    assert order_of(whole.where(condition).select("path", "level", "x", "y", "checksum")) == sorted(tuple(r) for r in whole.select("path", "level", "x", "y", "checksum", "size", "sound").toPandas().query(condition.replace(" or ", " | ").replace("=", "==").replace("<==", "<=").replace(">==", ">=")).loc[:, ["path", "level", "x", "y", "checksum"]].itertuples(index=False))


def test_only_what_is_asked_for_is_read(folder):
    data = (folder / "1.bin").read_bytes()
    reads = []

    def file():
        reads.clear()
        return ranged.Ranges(lambda at, n: reads.append((at, n)) or data[at : at + n], len(data))

    f = file()
    rows = [r for b in ranged.tiles_of(f, "p") for r in b.to_pylist()]
    assert len(rows) == 16 * 12 + 8 * 6 and f.read_bytes > 0.99 * len(data)
    index = ranged.HEADER_BYTES + 4 + 29 * len(rows)
    f = file()
    held = [r for b in ranged.tiles_of(f, "p", conditions=[("level", "=", 0), ("x", "=", 5), ("y", "=", 7)]) for r in b.to_pylist()]
    assert len(held) == 1 and f.read_bytes == index + held[0]["size"] < 0.02 * len(data) and f.reads == 4
    f = file()
    assert sum(b.num_rows for b in ranged.tiles_of(f, "p", with_payloads=False)) == len(rows) and f.read_bytes == index
    parts = [[(r["level"], r["x"], r["y"]) for b in ranged.tiles_of(file(), "p", run, 7) for r in b.to_pylist()] for run in range(7)]
    assert sorted(sum(parts, [])) == sorted((r["level"], r["x"], r["y"]) for r in rows) and all(parts)


def test_large_files_are_read_in_parts(spark, folder):
    assert ranged.read_tiles(spark, str(folder), runBytes=200_000).rdd.getNumPartitions() > 10
    assert ranged.read_tiles(spark, str(folder / "3.bin")).count() == 2
    with pytest.raises(Exception, match="path"):
        spark.read.format("tiled_container").load().count()
