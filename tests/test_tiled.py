"""Operators on tiles against the same on whole images."""

import numpy as np
import pytest

from tilewright.operators import pixels, tiled, vision


def plain_labels(mask):
    """Each marked pixel's component by flooding: {(x, y): first pixel in rows}."""
    left, out = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask))}, {}
    for start in sorted(left, key=lambda p: (p[1], p[0])):
        todo = [start] if start in left else []
        left -= {start}
        while todo:
            x, y = todo.pop()
            out[x, y] = start
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
    return out


@pytest.mark.parametrize("share", [0.2, 0.4, 0.7])
def test_roots_are_first_pixels(share):
    mask = np.random.default_rng(int(share * 10)).random((37, 23)) < share
    places, first = tiled.roots(mask)
    assert {(p % 23, p // 23): (f % 23, f // 23) for p, f in zip(places.tolist(), first.tolist())} == plain_labels(mask)
    assert len(tiled.roots(np.zeros((3, 3), dtype=bool))[0]) == 0 and tiled.roots(np.ones((1, 1), dtype=bool))[1].tolist() == [0]


@pytest.mark.parametrize("side", [4, 16])
def test_labels_do_not_depend_on_tiles(spark, side):
    rng = np.random.default_rng(side)
    masks = {("a", 1): rng.random((45, 50)) < 0.42, ("b", 1): rng.random((20, 70)) < 0.35, (None, 2): np.ones((9, 9), dtype=bool)}
    rows = [(*key, int(x) + 1000 * key[1], int(y)) for key, m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "name string, number int, x int, y int").repartition(3)
    got = {}
    for r in tiled.labels(df.where("name is not null"), ["name", "number"], side).collect():
        got.setdefault((r.name, r.number), {})[r.x - 1000 * r.number, r.y] = (r.label % tiled.ROW - 1000 * r.number, r.label // tiled.ROW)
    assert got == {key: plain_labels(m) for key, m in masks.items() if key[0]}


def test_the_graph_has_borders_only(spark):
    """A whole area: every pixel touches eight others, but tiles only their neighbours."""
    side, n = 16, 64
    area = spark.range(n * n).selectExpr("1 as image", "id % 64 as x", "id div 64 as y")
    local = tiled.local_roots(area, ["image"], side)
    edges = tiled.border_edges(local.where("border").select("image", "x", "y", "root"), ["image"], side)
    tiles = n // side
    assert edges.count() == 2 * tiles * (tiles - 1) + 2 * (tiles - 1) ** 2  # beside, below, and both diagonals
    assert local.where("border").count() == tiles * tiles * (4 * side - 4)
    assert {r.label for r in pixels.labels8(area.selectExpr("image", "cast(x as int) x", "cast(y as int) y", "200 as g"), ["image"], 128, side).collect()} == {0}


def pictures():
    rng = np.random.default_rng(5)
    ramp = np.zeros((70, 90))
    ramp[:, :20] = 40  # nowhere steep
    ramp[:, 45:] = 200 - 2.6 * np.arange(70)[:, None]  # an edge that fades over many tiles
    smooth = rng.random((12, 9))
    return {1: rng.integers(0, 256, (50, 61)), 2: ramp + rng.integers(0, 3, ramp.shape), 3: np.kron(smooth, np.ones((7, 7))) * 255, 4: rng.integers(0, 256, (3, 80)), 5: np.full((16, 16), 9), 6: rng.integers(0, 256, (1, 1))}


@pytest.mark.parametrize("side, low, high", [(8, 60, 250), (16, 30, 300), (32, 100, 100)])
def test_edges_of_tiles_are_those_of_images(spark, side, low, high):
    held = {k: np.clip(p, 0, 255).astype(np.uint8) for k, p in pictures().items()}
    rows = [(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in held.items()] + [(9, 2, 2, b"odd"), (10, None, None, None)]
    tiles = tiled.cut(spark.createDataFrame(rows, vision.IMAGE), side).repartition(4)
    got = {k: np.zeros_like(p) for k, p in held.items()}
    for r in tiled.canny(tiles, side, low, high).collect():
        got[r.id][r.ty * side : r.ty * side + r.height, r.tx * side : r.tx * side + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
    for k, p in held.items():
        assert (got[k] == vision.edges_of(p, low, high) * np.uint8(255)).all(), k
    assert got[2].any()


def test_weak_edges_reach_over_many_tiles():
    """The fading edge has weak pixels far from its strong ones, so the test above needs the graph."""
    p = np.clip(pictures()[2], 0, 255).astype(np.uint8)
    strong, weak = vision.thinned(p, 60, 250)
    kept = vision.edges_of(p, 60, 250)
    assert np.nonzero(kept)[0].max() > np.nonzero(strong)[0].max() + 16 and (weak & ~kept).any()


def test_wrong_sizes(spark):
    with pytest.raises(ValueError):
        tiled.canny(spark.createDataFrame([], tiled.TILED), 4)
    odd = spark.createDataFrame([(1, 0, 0, 8, 8, b"short"), (2, 0, 0, 8, 8, bytes(64))], tiled.TILED)
    assert [r.id for r in tiled.canny(odd, 8).collect()] == [2]
