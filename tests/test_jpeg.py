"""JPEG tiles, decoded by Spark's image source (another decoder than ours: we have none)."""

import os

import numpy as np
import pytest

from tilewright.plans import registry
from tilewright.sources import images, jpeg

from .compare import same
from .conftest import SF


def pictures():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack((x * 3 % 256, y * 4 % 256, (x + y) % 256), axis=2)
    return {"smooth": smooth, "noise": rng.integers(0, 256, (40, 33, 3)), "flat": np.full((8, 8, 3), 77), "dot": np.full((1, 1, 3), 200), "rgba": rng.integers(90, 110, (17, 64, 4)), "step": np.where(x[:, :, None] > 40, 230, 20) * np.ones(3, dtype=int)}


def decoded(spark, folder, quality):
    for name, p in pictures().items():
        (folder / f"{name}.jpg").write_bytes(jpeg.to_jpeg(p.astype(np.uint8), quality))
    out = {}
    for r in images.read_images(spark, str(folder)).collect():
        assert r.rgba is not None, r.path
        out[r.path.rsplit("/", 1)[-1][:-4]] = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)[:, :, :3].astype(int)
    return out


@pytest.mark.parametrize("quality", [100, 90, 50, 5])
def test_pixels_come_back_within_the_steps(spark, tmp_path, quality):
    """Each value of a block is off by half a step at most, and a pixel by what these add up to; colours mix three planes, rounding adds a little."""
    luma, chroma = (np.linalg.norm(jpeg.steps(t, quality) / 2) for t in (jpeg.LUMA_STEPS, jpeg.CHROMA_STEPS))
    got = decoded(spark, tmp_path, quality)
    for name, p in pictures().items():
        p = p[:, :, :3]
        assert got[name].shape == p.shape
        blocks = -(-p.shape[0] // 8) * -(-p.shape[1] // 8)
        apart = np.linalg.norm(got[name] - p) / np.sqrt(3)  # of all pixels; the transform keeps lengths
        assert apart <= np.sqrt(blocks) * (luma + 2 * chroma) + np.sqrt(p.size) * 1.5, (name, apart)
    if quality == 100:
        assert max(np.abs(got[n] - p[:, :, :3]).max() for n, p in pictures().items()) <= 3


def test_lower_qualities_are_smaller(tmp_path):
    sizes = [len(jpeg.to_jpeg(pictures()["smooth"].astype(np.uint8), q)) for q in (95, 75, 30, 10)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 61 * 83 * 3 / 2
    with pytest.raises(ValueError):
        jpeg.to_jpeg(np.zeros((0, 5, 3), dtype=np.uint8))
    with pytest.raises(ValueError):
        jpeg.to_jpeg(np.zeros((5, 5, 3), dtype=np.uint8), 0)


def test_codes_are_no_longer_than_sixteen_and_leave_the_ones():
    counts = np.zeros(256, dtype=int)
    counts[:40] = [int(1.7**k) for k in range(40)]  # plain Huffman codes would have 39 bits
    lengths = jpeg.code_lengths(counts)
    assert set(lengths) == set(range(40)) and max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) < 1
    body, codes, sizes = jpeg.canonical(lengths)
    assert sum(body[:16]) == 40 == len(body) - 16
    words = sorted(f"{codes[s]:0{sizes[s]}b}" for s in range(40))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and all("0" in w for w in words)
    one = np.bincount([7], minlength=256)
    assert jpeg.code_lengths(one) == {7: 1}


def test_the_diagonals_turn():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def test_files_are_read_folder_by_folder(spark, duck, monkeypatch):
    """Spark's image source lists what it reads in the driver: no folder holds the tiles of all images."""
    listed, read = [], images.read_images

    def counted(session, path):
        listed.append(sum(not name.startswith(".") for name in os.listdir(path.removeprefix("file://"))))
        return read(session, path)

    monkeypatch.setattr(images, "FILES_AT_ONCE", 600, raising=False)
    monkeypatch.setattr(images, "read_images", counted)
    df = registry.queries()["snk8_jpeg_tiles"](spark, SF)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert max(listed) < 800 and sum(listed) == 2000 and len(listed) == 4
    same(df, duck.sql(registry.oracle_sql()["snk8_jpeg_tiles"]))


def test_no_files_and_broken_ones(spark, tmp_path):
    none = images.through_files(spark.createDataFrame([], "name string, content binary"), f"file://{tmp_path}/none")
    assert none.count() == 0 and none.columns == ["id", "path", "width", "height", "rgba"]
    good = jpeg.to_jpeg(pictures()["flat"].astype(np.uint8))
    rows = [("a.jpg", good), ("b.jpg", b"no image"), ("c.jpg", good)]
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.rgba is not None) for r in images.through_files(spark.createDataFrame(rows, "name string, content binary"), f"file://{tmp_path}/some").collect()}
    assert got["a.jpg"] == got["c.jpg"] == (8, 8, True) and not got.get("b.jpg", (None, None, False))[2]
