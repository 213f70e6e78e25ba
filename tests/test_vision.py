import numpy as np

from tilewright.operators import vision as X
from tilewright.plans import views as V
from tilewright.plans import vision_queries as Q
from tilewright.streaming.cache import Lru

from .conftest import SF


def test_edges_stand_at_the_step():
    image = np.zeros((20, 20), dtype=np.uint8)
    image[:, 10:] = 200
    found = np.argwhere(X.edges_of(image, 50, 100))
    assert set(found[:, 1]) <= {9, 10} and len(set(found[:, 0])) == 20
    assert not X.edges_of(np.full((9, 9), 77, dtype=np.uint8), 50, 100).any()


def test_weak_edges_need_strong_ones():
    fading = np.zeros((12, 30), dtype=np.uint8)
    fading[:, 15:] = 200 - 12 * np.arange(12)[:, None]
    assert X.edges_of(fading, 60, 250)[11].any() and not X.edges_of(fading[8:], 60, 250).any()


def test_walks_take_each_pixel_once_in_order():
    marked = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 0]], dtype=bool)
    assert list(X.walks(marked)) == [[(0, 0), (1, 0), (2, 1)], [(0, 2)]]
    rng = np.random.default_rng(1)
    marked = rng.random((30, 40)) < 0.4
    points = [p for path in X.walks(marked) for p in path]
    assert len(points) == len(set(points)) == marked.sum()
    assert all(max(abs(a - c), abs(b - d)) == 1 for path in X.walks(marked) for (a, b), (c, d) in zip(path, path[1:]))


def test_resampling_keeps_flat_and_same_size_images():
    image = np.random.default_rng(2).integers(0, 256, (9, 7)).astype(np.uint8)
    assert (X.resized(image, 7, 9) == image).all()
    assert (X.resized(np.full((16, 16), 93, dtype=np.uint8), 5, 3) == 93).all()


def test_queries_and_odd_images(spark):
    assert Q.lanczos_level(spark, SF).where("width <> 4 or length(data) <> 32").count() == 0
    assert Q.canny_edges(spark, SF).count() == Q.grey_images(spark, SF).count()
    same = Q.grey_images(spark, SF).selectExpr("id", "conv(hex(substring(data, 10, 1)), 16, 10) as g").join(V.pixels(spark, SF).where("x = 1 and y = 1"), (V.F.col("id") == V.F.col("vec_id")))
    assert same.where("cast(hex(0) as int) <> 0").count() == 0 and same.count() == Q.grey_images(spark, SF).count()
    assert Q.contour_paths(spark, SF).where("kind = 'move'").count() > 0
    odd = spark.createDataFrame([(1, 2, 2, b"abc"), (2, 0, 0, b""), (3, 1, 1, None), (4, 1, 1, b"\xff")], X.IMAGE)
    assert [r.id for r in X.canny(odd).collect()] == [4] and X.lanczos(odd, 1).count() == 0 and X.contour_walks(odd).count() == 0


def test_cache_by_hand():
    c = Lru(10)
    for tile, size in ((1, 4), (2, 4), (1, 4), (3, 4), (2, 4), (9, 99)):
        c.access(tile, size)
    assert (c.hits, c.misses, c.evictions) == (1, 5, 4) and not c.held


def test_cache_stream_is_the_plain_cache(spark):
    rows = V.table(spark, SF, "events").orderBy("ts", "event_id").collect()
    want: dict[int, Lru] = {}
    for r in rows:
        want.setdefault(r.user_id, Lru(20_000)).access(r.event_id % 23, int(r.value * 100 // 1) % 5000)
    got = {r.client: (r.tiles, r.bytes, r.hits, r.misses, r.evictions) for r in Q.cache_stream(spark, SF).collect()}
    assert got == {k: (len(c.held), sum(c.held.values()), c.hits, c.misses, c.evictions) for k, c in want.items()}
