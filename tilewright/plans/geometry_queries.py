"""Queries on boxes, contours and paths."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import contours as C
from ..operators import segments as G
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


OVERLAP = "a.x < b.x + b.w and a.x + a.w > b.x and a.y < b.y + b.h and a.y + a.h > b.y"


@query("flt1_region_boxes", "select id from v_part_boxes where x < 5000 and x + w > 1000 and y < 4000 and y + h > 500")
def region_boxes(spark, sf_dir):
    return B.in_region(V.part_boxes(spark, sf_dir), 1000.0, 500.0, 4000.0, 3500.0).select("id")


@query("flt2_contains_point", "select id from v_supplier_boxes where 485.0 between x and x + w and 560.0 between y and y + h or 1000.0 between x and x + w")
def contains_point(spark, sf_dir):
    boxes = V.supplier_boxes(spark, sf_dir)
    return boxes.where(B.contains(F.lit(485.0), F.lit(560.0)) | F.lit(1000.0).between(F.col("x"), F.col("x") + F.col("w"))).select("id")


@query("jn4_box_overlap", f"select a.id as left_id, b.id as right_id from v_part_boxes a join v_supplier_boxes b on {OVERLAP}")
def box_overlap(spark, sf_dir):
    return B.overlap_join(V.part_boxes(spark, sf_dir), V.supplier_boxes(spark, sf_dir))


@query("jn5_layers_then_paths", "select s.id as layer, p.id as path from (select * from v_supplier_boxes where x < 6000 and x + w > 0 and y < 6000 and y + h > 0) s join v_part_boxes p on p.id % 100 = s.id % 100 where p.x < 6000 and p.x + p.w > 0 and p.y < 6000 and p.y + p.h > 0")
def layers_then_paths(spark, sf_dir):
    layers = B.in_region(V.supplier_boxes(spark, sf_dir), 0.0, 0.0, 6000.0, 6000.0).select(F.col("id").alias("layer"), (F.col("id") % 100).alias("k"))
    paths = B.in_region(V.part_boxes(spark, sf_dir).withColumn("k", F.col("id") % 100), 0.0, 0.0, 6000.0, 6000.0).select(F.col("id").alias("path"), "k")
    return layers.join(paths, "k").select("layer", "path")


@query("agg4_union_box", "select id % 7 as layer, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from v_part_boxes group by 1")
def union_box(spark, sf_dir):
    return B.union_box(V.part_boxes(spark, sf_dir).withColumn("layer", F.col("id") % 7), ["layer"])


@query("set5_append_layer", "select min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from (select * from v_part_boxes union all select * from v_supplier_boxes)")
def append_layer(spark, sf_dir):
    return B.union_box(V.part_boxes(spark, sf_dir).unionByName(V.supplier_boxes(spark, sf_dir)))


@query("prj8_device_coordinates", "select id, x / 1920.0 * 2 - 1 as nx, 1 - y / 1080.0 * 2 as ny from v_part_boxes")
def device_coordinates(spark, sf_dir):
    return V.part_boxes(spark, sf_dir).select("id", *B.device_coordinates(F.col("x"), F.col("y"), 1920.0, 1080.0))


@query("prj9_scaled_boxes", "select id, (x - 100.0) * 0.25 as x, (y - 50.0) * 0.25 as y, w * 0.25 as w, h * 0.25 as h from v_part_boxes")
def scaled_boxes(spark, sf_dir):
    return B.scaled(V.part_boxes(spark, sf_dir), 100.0, 50.0, 2)


@query("prj11_triangles", "select id, k as vertex, case when k in (0, 2, 5) then x else x + w end as vx, case when k in (0, 1, 3) then y else y + h end as vy from v_supplier_boxes, range(6) t(k)")
def triangles(spark, sf_dir):
    return B.triangles(V.supplier_boxes(spark, sf_dir)).withColumn("vertex", F.col("vertex").cast("long"))


WHOLE = "select id, greatest(floor(x - 5.5), 0)::bigint as x, floor(y)::bigint as y, floor(w)::bigint as w, floor(h)::bigint as h, '{kind}' as region_type from {view}"


def whole(boxes, kind):
    return B.whole(boxes.withColumn("x", F.col("x") - 5.5), kind)


@query("prj13_whole_regions", "select id, greatest(floor(x - 5.5), 0)::bigint as x, floor(y)::bigint as y, floor(w)::bigint as w, floor(h)::bigint as h, 'vector' as region_type from v_part_boxes union all select id, greatest(floor(x - 5.5), 0)::bigint, floor(y)::bigint, floor(w)::bigint, floor(h)::bigint, 'raster' from v_supplier_boxes")
def whole_regions(spark, sf_dir):
    """Vector and raster regions as whole pixels, none of them negative."""
    return whole(V.part_boxes(spark, sf_dir), "vector").unionByName(whole(V.supplier_boxes(spark, sf_dir), "raster"))


@query("set3_region_union", WHOLE.format(kind="vector", view="v_part_boxes") + " union all " + WHOLE.format(kind="raster", view="v_supplier_boxes"))
def vector_and_raster(spark, sf_dir):
    """Vector and raster regions as one list: the survey has the two ids of one piece of code."""
    return whole_regions(spark, sf_dir)


EDGES = "(select *, coalesce(lead(x) over w, first(x) over w) as nx, coalesce(lead(y) over w, first(y) over w) as ny, count(*) over (partition by contour_id) as n from v_points window w as (partition by contour_id order by seq rows between unbounded preceding and unbounded following))"
MEASURED = f"(select contour_id, count(*) as points, min(x) as x, min(y) as y, max(x) - min(x) as w, max(y) - min(y) as h, abs(sum(x * ny - nx * y)) / 2 as area, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) as perimeter from {EDGES} group by 1)"


@query("agg5_contour_bounds", "select contour_id, min(x) as x, min(y) as y, max(x) - min(x) as w, max(y) - min(y) as h from v_points group by 1")
def contour_bounds(spark, sf_dir):
    return C.measures(V.points(spark, sf_dir)).select("contour_id", "x", "y", "w", "h")


@query("agg6_area", f"select contour_id, points, area from {MEASURED}")
def area(spark, sf_dir):
    return C.measures(V.points(spark, sf_dir)).select("contour_id", "points", "area")


@query("agg7_perimeter", f"select contour_id, perimeter from {MEASURED}")
def perimeter(spark, sf_dir):
    return C.measures(V.points(spark, sf_dir)).select("contour_id", F.round("perimeter", 6).alias("perimeter"))


@query("agg8_complexity", f"select contour_id, round(case when perimeter = 0 then 0.0 when area > 0 then perimeter / (2 * {math.pi!r} * sqrt(area / {math.pi!r})) end, 4) as complexity from {MEASURED}")
def complexity(spark, sf_dir):
    return C.measures(V.points(spark, sf_dir)).select("contour_id", F.round("complexity", 4).alias("complexity"))


@query("agg9_edge_density", f"select contour_id, round(case when w * h = 0 then 0.0 else perimeter / (w * h) end, 4) as edge_density from {MEASURED}")
def edge_density(spark, sf_dir):
    return C.measures(V.points(spark, sf_dir)).select("contour_id", F.round("edge_density", 4).alias("edge_density"))


@query("flt17_kept_contours", f"select contour_id from {MEASURED} where points >= 3 and area >= 100")
def kept_contours(spark, sf_dir):
    return C.kept(C.measures(V.points(spark, sf_dir))).select("contour_id")


@query("flt18_region_type", f"select contour_id, case when perimeter / (2 * {math.pi!r} * sqrt(area / {math.pi!r})) < 1.5 and perimeter / (w * h) > 0.01 then 'vector' else 'raster' end as region_type from {MEASURED} where points >= 3 and area >= 100 and w * h > 0")
def region_type(spark, sf_dir):
    return C.region_type(C.kept(C.measures(V.points(spark, sf_dir))).where("w * h > 0"), 0.01, 1.5).select("contour_id", "region_type")


PROBES = "(select contour_id * 4 + k as probe_id, contour_id, avg(x) + k * 7.25 as px, avg(y) + k * 0.5 as py from v_points, range(3) t(k) group by contour_id, k)"


@query("flt3_point_in_polygon", f"select probe_id, contour_id from (select probe_id, e.contour_id, count(*) filter ((e.y > py) <> (e.ny > py) and px < (e.nx - e.x) * (py - e.y) / nullif(e.ny - e.y, 0) + e.x) as hits from {PROBES} p join {EDGES} e on e.contour_id = p.contour_id where n >= 3 group by all) where hits % 2 = 1")
def point_in_polygon(spark, sf_dir):
    p = V.points(spark, sf_dir)
    probes = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).groupBy("contour_id", "k").agg((F.avg("x") + F.col("k") * 7.25).alias("px"), (F.avg("y") + F.col("k") * 0.5).alias("py"))
    return C.points_inside(probes.select((F.col("contour_id") * 4 + F.col("k")).alias("probe_id"), "contour_id", "px", "py"), p)


COMMANDS = "(select contour_id as path_id, seq, case when seq = 0 then 'move' else 'line' end as kind, x, y from (select *, count(*) over (partition by contour_id) as n from v_points) where n > 2 union all select contour_id, count(*), 'close', null, null from v_points group by contour_id having count(*) > 3)"


@query("flt22_path_commands", f"select * from {COMMANDS}")
def path_commands(spark, sf_dir):
    return C.path_commands(V.points(spark, sf_dir))


@query("prj7_moved_paths", f"select path_id, seq, kind, x + path_id % 10 * 64 as x, y + 32 as y from {COMMANDS}")
def moved_paths(spark, sf_dir):
    return C.moved(C.path_commands(V.points(spark, sf_dir)), F.col("path_id") % 10 * 64, F.lit(32))


@query("px8_bezier", "select id, k / 8.0 as t, round((1 - k / 8.0) * (1 - k / 8.0) * x + 2 * (1 - k / 8.0) * (k / 8.0) * y + (k / 8.0) * (k / 8.0) * w, 6) as qx, round(power(1 - k / 8.0, 3) * x + 3 * power(1 - k / 8.0, 2) * (k / 8.0) * y + 3 * (1 - k / 8.0) * power(k / 8.0, 2) * w + power(k / 8.0, 3) * h, 6) as cx from (select id, x, y, w, h, k::double as k from v_supplier_boxes, range(9) t(k))")
def bezier(spark, sf_dir):
    b = V.supplier_boxes(spark, sf_dir).select("id", F.col("x").alias("p0"), F.col("y").alias("p1"), F.col("w").alias("p2"), F.col("h").alias("p3"))
    return C.bezier(b).select("id", "t", F.round("qx", 6).alias("qx"), F.round("cx", 6).alias("cx"))


@query("px9_segments", "select id, kind, floor(greatest(case kind when 'quadratic' then 8.0::double else 16.0::double end, case kind when 'quadratic' then abs(y - (x + w) * 0.5::double) else abs(y - x) + abs(w - y) + abs(h - w) end / 4.0::double))::bigint as segments from v_supplier_boxes, (values ('quadratic'), ('cubic')) t(kind)")
def segments(spark, sf_dir):
    """Into how many pieces curves are cut, from their control points in one coordinate."""
    b = V.supplier_boxes(spark, sf_dir).withColumn("kind", F.explode(F.array(F.lit("quadratic"), F.lit("cubic"))))
    x, y, w, h = (F.col(c) for c in "xywh")
    return b.select("id", "kind", C.segments(F.abs(y - (x + w) * 0.5), F.abs(y - x) + F.abs(w - y) + F.abs(h - w), 4.0, F.col("kind")).alias("segments"))


@query("prj10_transform", "select id, 2.0::double / w * 1.5::double as m00, 2.0::double / h * 1.5::double as m11, -1.0::double - x * (2.0::double / w) as m30, -1.0::double - y * (2.0::double / h) as m31, 1.0::double as m33 from v_part_boxes")
def transform(spark, sf_dir):
    """The entries of the matrix to device coordinates that are not 0."""
    m = V.part_boxes(spark, sf_dir).select("id", C.transform(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(1.5)).alias("m"))
    return m.select("id", *(F.col("m")[i][j].alias(f"m{i}{j}") for i, j in ((0, 0), (1, 1), (3, 0), (3, 1), (3, 3))))


SEGMENTS = """(select p_partkey % 10 as image, 'edge' as source, p_partkey as id, (p_partkey % 291)::double as x, (p_partkey % 149)::double as y, (p_size + 10)::double as w, (p_size % 7 + 20)::double as h, (p_partkey * 37 % 101) / 100.0::double as confidence from part
  union all select s_suppkey % 10, 'model', s_suppkey, (s_suppkey * 13 % 291)::double, (s_suppkey * 7 % 149)::double, (30 + s_suppkey % 9)::double, 25::double, (s_suppkey * 53 % 101) / 100.0::double from supplier)"""


def both_engines(spark, sf_dir):
    """Regions of ten images: parts as those by edges, suppliers as those of a model."""
    p, k, s = V.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("s_suppkey")
    real = lambda c: c.cast("double")
    edge = p.select((k % 10).alias("image"), F.lit("edge").alias("source"), k.alias("id"), real(k % 291).alias("x"), real(k % 149).alias("y"), real(F.col("p_size") + 10).alias("w"), real(F.col("p_size") % 7 + 20).alias("h"), (k * 37 % 101 / F.lit(100.0)).alias("confidence"))
    model = V.table(spark, sf_dir, "supplier").select((s % 10).alias("image"), F.lit("model").alias("source"), s.alias("id"), real(s * 13 % 291).alias("x"), real(s * 7 % 149).alias("y"), real(30 + s % 9).alias("w"), F.lit(25.0).alias("h"), (s * 53 % 101 / F.lit(100.0)).alias("confidence"))
    return edge.unionByName(model)


@query("gen12_merged_regions", f"""with recursive r as (select *, row_number() over (partition by image order by confidence desc, source, id) as n from {SEGMENTS}),
g as (select distinct image, 0::bigint as n, []::struct(source varchar, id bigint, x double, y double, w double, h double)[] as kept from r
  union all select g.image, r.n, case when len(list_filter(g.kept, lambda k: greatest(least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x), 0) * greatest(least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y), 0)
    >= greatest(0.5::double * (k.w * k.h + r.w * r.h - greatest(least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x), 0) * greatest(least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y), 0)), 1e-300::double))) > 0
    then g.kept else list_append(g.kept, {{'source': r.source, 'id': r.id, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}}) end from g join r on r.image = g.image and r.n = g.n + 1),
last as (select image, unnest(arg_max(kept, n)) as k from g group by image)
select image, k.source as source, k.id as id from last""")
def merged_regions(spark, sf_dir):
    """Regions of two engines: of those that overlap by half the most confident stay."""
    return G.merged(both_engines(spark, sf_dir)).select("image", "source", "id")
