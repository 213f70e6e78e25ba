"""Images to files and back: equal pixels, equal paths, and the command."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.__main__ import main
from tilewright.operators import encoder as E
from tilewright.sources import codecs, images
from tilewright.sources import container as S


def picture(width, height, seed):
    """A bright box on dark noise, with a part that cannot be seen."""
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 20, (height, width, 4)).astype(np.uint8)
    image[:, :, 3] = 255
    image[height // 4 : height // 2, width // 4 : width // 2, :3] = 230
    image[-height // 3 :, -width // 3 :, 3] = 0
    return image


@pytest.fixture(scope="module")
def pictures():
    return {1: picture(150, 90, 1), 2: picture(64, 64, 2), 3: np.zeros((70, 70, 4), dtype=np.uint8)}


@pytest.fixture(scope="module")
def rows(spark, pictures):
    return spark.createDataFrame([(k, p.shape[1], p.shape[0], p.tobytes(), "x") for k, p in pictures.items()] + [(9, 5, 5, b"odd", "x"), (10, None, None, None, "x")], images.RGBA + ", path string")


def test_encode_and_read_again(spark, rows, pictures):
    files = E.encode(rows, 64, 2).cache()
    assert {r.file_id for r in files.select("file_id").collect()} == {1, 2, 3, 9}
    parts = S.sections(files)
    meta = {r.file_id: r for r in S.parse_metadata(parts).collect()}
    assert all(meta[k].error is None and (meta[k].width, meta[k].height) == (p.shape[1], p.shape[0]) for k, p in pictures.items())
    seen = {k: np.zeros_like(p) for k, p in pictures.items()}
    levels = {}
    for r in S.decode_tiles(S.payloads(parts).where("sound")).collect():
        levels.setdefault(r.file_id, set()).add(r.level)
        if r.level == 0:
            seen[r.file_id][64 * r.y : 64 * r.y + r.height, 64 * r.x : 64 * r.x + r.width] = np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)
    for k, p in pictures.items():
        shown = np.zeros(p.shape[:2], dtype=bool)
        for y in range(0, p.shape[0], 64):
            for x in range(0, p.shape[1], 64):
                shown[y : y + 64, x : x + 64] = p[y : y + 64, x : x + 64, 3].any()
        assert (seen[k] == p * shown[:, :, None]).all()
    assert levels == {1: {0, 1, 2}, 2: {0, 1, 2}}
    written = E.traced(rows)
    columns = ["file_id", "layer_id", "path_id", "seq", "kind", "x", "y"]
    assert sorted(map(str, S.parse_paths(parts).select(*columns).collect())) == sorted(map(str, written.select(*columns).collect()))
    assert {r.file_id for r in written.select("file_id").distinct().collect()} == {1, 2}
    assert S.vector_violations(S.parse_paths(parts)).count() == 0


def test_render_draws_paths_over_tiles(spark, pictures, rows):
    box = [(2, 0, "l", 0.25, "normal", 0, [1.0, 0.0, 0.0, 1.0], k, kind, x, y) for k, (kind, x, y) in enumerate([("move", 3.0, 2.0), ("line", 9.0, 2.0), ("line", 9.0, 7.0), ("line", 3.0, 7.0), ("close", None, None)])]
    over = [(2, 1, "m", 1.0, "normal", 0, [0.0, 1.0, 0.0, 0.5], k, kind, x, y) for k, (kind, x, y) in enumerate([("move", 5.0, 1.0), ("line", 30.0, 1.0), ("line", 30.0, 4.0), ("line", 5.0, 4.0)])]
    vectors = spark.createDataFrame(box + over, S.VECTORS)
    meta = rows.where("id = 2").select(F.col("id").alias("file_id"), F.col("width").cast("long"), F.col("height").cast("long"), F.lit(32).cast("long").alias("tile_size"), F.lit(0).alias("max_zoom_level"))
    files = S.write_files(S.encode_tiles(E.pyramid(rows.where("id = 2"), 32, 0)), meta, vectors)
    regions = spark.createDataFrame([(2, 0, 1, 0, 70, 12)], "file_id long, level long, rx long, ry long, rw long, rh long")
    want = np.zeros((12, 70, 4), dtype=np.int64)
    want[:, :63] = pictures[2][:12, 1:64]
    for (x0, x1, y0, y1), fill, share in (((3, 9, 2, 7), (255.0, 0.0, 0.0), 0.25), ((5, 30, 1, 4), (0.0, 255.0, 0.0), 0.5)):
        part = want[y0:y1, x0 - 1 : x1 - 1]
        part[:, :, :3] = np.floor(np.array(fill) * share + part[:, :, :3] * (1 - share))
        part[:, :, 3] = np.maximum(part[:, :, 3], int(share * 255))
    got = np.full((12, 70, 4), -1)
    for r in E.render(files, regions).collect():
        got[r.y, r.x - 1] = (r.r, r.g, r.b, r.a)
    assert (got == want).all()


def test_image_files_and_the_command(spark, pictures, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in (1, 2):
        (folder / f"p{k}.png").write_bytes(codecs.to_png(pictures[k]))
    (folder / "broken.png").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.read_images(spark, str(folder)).collect()}
    for k in (1, 2):
        r = got[f"p{k}.png"]
        assert (np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4) == pictures[k]).all()
    assert got["broken.png"].rgba is None
    out = f"file://{tmp_path}/out"
    assert main(["encode", str(folder / "p*.png"), "--out", out, "--tile-size", "64", "--max-zoom", "1"], spark) == 0
    assert capsys.readouterr().out.split() == ["p1.vera", "p2.vera"]
    assert main(["validate", f"{tmp_path}/out"], spark) == 0
    assert main(["encode", str(folder), "--out", out, "--tile-size", "64"], spark) == 1 and "broken.png" in capsys.readouterr().err
    assert main(["encode", str(folder), "--out", out, "--tile-size", "65"], spark) == 2 and main(["encode", str(folder)], spark) == 2
    assert main(["extract", f"{tmp_path}/out", "--level", "0", "--out", f"file://{tmp_path}/tiles"], spark) == 0
    kept = sorted(p.parent.parent.name for p in (tmp_path / "tiles").glob("file_*/level_0/*.png"))
    assert len(set(kept)) == 2 and not list((tmp_path / "tiles").rglob(".*"))


def test_prefetch_takes_the_nearest_first(spark):
    ahead = spark.createDataFrame([(1, 130.0), (2, 10.0)], "client long, ahead double")
    cached, loading = (spark.createDataFrame([r], "client long, x long, y long") for r in ((1, 2, 0), (1, 3, 0)))
    got = [(r.client, r.x, r.y, r.place) for r in E.prefetched(ahead, cached, loading, 64, 3).orderBy("client", "place").collect()]
    assert got == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 1, 3), (2, 0, 0, 1), (2, 1, 0, 2), (2, 0, 1, 3)]
