"""Cases worked out by hand, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tilewright.operators import boxes as B
from tilewright.operators import contours as C
from tilewright.operators import metrics as M
from tilewright.operators import pixels as P
from tilewright.operators import tiles as T

META = "file_id long, width long, height long, tile_size long, max_zoom_level int, version long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_boxes_that_touch_do_not_overlap(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "id long, x double, y double, w double, h double")
    b = spark.createDataFrame([(2, 10.0, 0.0, 5.0, 5.0), (3, 9.5, 9.0, 1.0, 5.0), (4, -3.0, -3.0, 200.0, 200.0)], "id long, x double, y double, w double, h double")
    assert rows(B.overlap_join(a, b, 4.0)) == [(1, 3), (1, 4)]
    assert rows(B.overlap_join(b, a, 4.0)) == [(3, 1), (4, 1)]
    assert a.where(B.contains(F.lit(10.0), F.lit(10.0))).count() == 1


def test_overlap_join_is_an_equi_join(spark):
    a = spark.range(50).select("id", *(F.rand(k).alias(c) for k, c in enumerate(("x", "y", "w", "h"))))
    plan = B.overlap_join(a, a)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tile_counts(spark):
    meta = spark.createDataFrame([(1, 1920, 1080, 512, 10, 1), (2, 1000, 3, 64, 5, 1)], META)
    assert rows(T.tile_count(meta)) == [(1, 25), (2, 32)]
    assert rows(T.tile_count(meta, "floor"))[1] == (2, 24)
    assert rows(T.grid(meta, "floor").groupBy("file_id").count())[1] == (2, 24)


def test_tile_origins_map_back(spark):
    t = spark.range(40).select((F.col("id") % 4).cast("int").alias("level"), (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"))
    t = t.select("*", *T.tile_bounds(F.col("x"), F.col("y"), F.col("level"), 64))
    assert t.where((T.pixel_to_tile(F.col("px"), F.col("level"), 64) != F.col("x")) | (T.pixel_to_tile(F.col("py"), F.col("level"), 64) != F.col("y"))).count() == 0


def test_rings(spark):
    centre = spark.createDataFrame([(50, 50)], "cx long, cy long")
    assert T.rings(centre).count() == 361
    assert T.rings(spark.createDataFrame([(0, 0)], "cx long, cy long")).count() == 100


def test_empty_rectangle_and_index(spark):
    rect = spark.createDataFrame([(1, 0, 0, 0, 0, 5)], "rect long, level int, rx long, ry long, rw long, rh long")
    assert T.candidates(rect, 64).count() == 0
    empty = spark.createDataFrame([], "level int, x long, y long, size long")
    assert T.with_offsets(empty).count() == T.bucketed_offsets(empty).count() == 0


def test_offsets_follow_each_other(spark):
    index = spark.range(200).select((F.col("id") % 3).cast("int").alias("level"), (F.col("id") % 11).alias("x"), (F.col("id") * 7).alias("y"), (F.col("id") % 13).alias("size"))
    a, b = rows(T.with_offsets(index).select("offset", "size")), rows(T.bucketed_offsets(index).select("offset", "size"))
    assert a == b
    assert max(o + s for o, s in a) == sum(s for _, s in a)


def test_tile_spec(spark):
    df = spark.createDataFrame([("3/10_20",), ("3/10",), ("a/1_2",), ("1/2_3_4",), ("",)], "s string").select(*T.parse_spec(F.col("s")))
    assert [tuple(r) for r in df.collect()] == [(3, 10, 20)] + [(None,) * 3] * 4


def test_square_contour(spark):
    square = [(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    line = [(2, 0, 0.0, 0.0), (2, 1, 3.0, 4.0)]
    points = spark.createDataFrame(square + line, "contour_id long, seq int, x double, y double")
    one, two = C.measures(points).orderBy("contour_id").collect()
    assert (one.area, one.perimeter, two.area, two.perimeter) == (16.0, 16.0, 0.0, 10.0)
    assert one.complexity == pytest.approx(16 / (2 * math.sqrt(math.pi * 16))) and one.complexity >= 1 and two.complexity is None
    probes = spark.createDataFrame([(1, 1, 2.0, 2.0), (2, 1, 5.0, 2.0), (3, 2, 1.0, 1.0)], "probe_id long, contour_id long, px double, py double")
    assert rows(C.points_inside(probes, points)) == [(1, 1)]
    assert {r.kind for r in C.path_commands(points).collect()} == {"move", "line", "close"}


def test_area_does_not_depend_on_the_first_point(spark):
    ring = [(0.0, 0.0), (5.0, 1.0), (7.0, 6.0), (2.0, 8.0)]
    data = [(k, i, *ring[(i + k) % 4]) for k in range(4) for i in range(4)]
    areas = {r.area for r in C.measures(spark.createDataFrame(data, "contour_id long, seq int, x double, y double")).collect()}
    assert len(areas) == 1


@pytest.mark.parametrize(("bps", "name"), [(1_000_000, "low"), (1_000_001, "medium"), (10_000_001, "full"), (500_000, "thumbnail"), (0, "thumbnail")])
def test_quality_limits_belong_below(spark, bps, name):
    assert spark.range(1).select(M.quality(F.lit(bps))).first()[0] == name


def test_smoothing_by_hand(spark):
    s = spark.createDataFrame([(1, k, k, 500_000) for k in range(3)], "client long, event_id long, us long, bps long")
    assert M.smoothed(s).first().ema == 756_000


def test_motion_ignores_steps_without_time(spark):
    v = spark.createDataFrame([(1, 1, 0, 0.0), (1, 2, 1_000_000, 10.0), (1, 3, 1_000_000, 99.0), (1, 4, 2_000_000, 109.0)], "client long, event_id long, us long, x double")
    got = M.motion(v).orderBy("event_id").collect()
    assert [r.velocity for r in got] == [0.0, 10.0, 10.0, 10.0]
    assert [r.acceleration for r in got] == [0.0, 10.0, 10.0, 0.0]
    assert [r.moves for r in got] == [0, 1, 1, 2]


def test_empty_mask_and_components(spark):
    p = spark.range(64).select(F.lit(1).alias("i"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") / 8).cast("int").alias("y"))
    got = P.mask_measures(p.withColumn("inside", F.lit(False)), ["i"]).first()
    assert got.area == 0 and got.x is None and got.edge_density == 0.0
    lit = p.withColumn("g", F.when(((F.col("x") < 2) & (F.col("y") == F.col("x"))) | (F.col("x") == 6), 255).otherwise(0))
    labels = P.labels8(lit, ["i"])
    assert labels.select("label").distinct().count() == 2 and labels.count() == 10


def test_overlay_is_the_usual_one(spark):
    dark = spark.range(1).select(P.mix_channel("overlay", F.lit(0.5), F.lit(0.25))).first()[0]
    light = spark.range(1).select(P.mix_channel("overlay", F.lit(0.5), F.lit(0.75))).first()[0]
    assert (dark, light) == (0.25, 0.75)


def test_kernel_sums_to_one(spark):
    k = P.gaussian_kernel(spark.range(1), 1.0).collect()
    assert len(k) == P.kernel_size(1.0) == 7 and sum(r.weight for r in k) == pytest.approx(1)
