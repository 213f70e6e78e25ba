"""Queries on pixels: features, masks, colours, filters and compositing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import tiles as T
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["vec_id"]


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def masked(spark, sf_dir):
    return P.mask(V.pixels(spark, sf_dir), F.col("g") / 255, 0.5)


MASK = "(select *, g / 255.0 > 0.5 as inside from v_pixels)"
NEAR = f"(select *, lag(inside) over r as l, lead(inside) over r as ri, lag(inside) over c as u, lead(inside) over c as d from {MASK} window r as (partition by vec_id, y order by x), c as (partition by vec_id, x order by y))"
MEASURED = f"""(select *, edge_density * (1 - area / total::double) as complexity from (select vec_id, count(*) filter (inside) as area, count(*) as total, min(case when inside then x end) as x, min(case when inside then y end) as y,
  max(case when inside then x end) - min(case when inside then x end) + 1 as w, max(case when inside then y end) - min(case when inside then y end) + 1 as h,
  coalesce((count(*) filter (inside and l is not null and ri is not null and u is not null and d is not null and not (l and ri and u and d)))::double / nullif(count(*) filter (inside and l is not null and ri is not null and u is not null and d is not null), 0), 0.0) as edge_density from {NEAR} group by vec_id))"""


@query("flt4_not_empty", "select vec_id from v_rgba group by 1 having not bool_and(a = 0)")
def not_empty(spark, sf_dir):
    return P.not_empty(V.rgba(spark, sf_dir), BY)


@query("agg3_block_density", "select vec_id, (x // 4)::bigint as bx, (y // 4)::bigint as by_, count(*) filter (g > 150)::double / count(*) as density from v_pixels group by all")
def block_density(spark, sf_dir):
    return P.block_density(V.pixels(spark, sf_dir).withColumn("edge", F.col("g") > 150), BY, 4)


@query("flt16_block_type", "select vec_id, (x // 4)::bigint as bx, (y // 4)::bigint as by_, case when count(*) filter (g > 150)::double / count(*) > 0.1 then 'vector' else 'raster' end as region_type from v_pixels group by all")
def block_type(spark, sf_dir):
    return P.block_type(block_density(spark, sf_dir)).select("vec_id", "bx", "by_", "region_type")


@query("agg10_texture", "select vec_id, sqrt((count(*) * sum(g * g) - sum(g) * sum(g))::double) / count(*) / 255 as texture from v_pixels group by 1")
def texture(spark, sf_dir):
    return P.texture(V.pixels(spark, sf_dir), BY)


VAR = "(count(*) * sum({0} * {0}) - sum({0}) * sum({0}))::double / (count(*) * count(*))"


@query("agg11_colour_variance", f"select vec_id, sqrt(({VAR.format('r')} + {VAR.format('g')} + {VAR.format('b')}) / 3) / 255 as variance from v_rgba group by 1")
def colour_variance(spark, sf_dir):
    return P.colour_variance(V.rgba(spark, sf_dir), BY)


LAPLACE = "(select *, lag(g) over r as l, lead(g) over r as ri, lag(g) over c as u, lead(g) over c as d from v_pixels window r as (partition by vec_id, y order by x), c as (partition by vec_id, x order by y))"


@query("agg12_noise", f"select vec_id, sum(abs(4 * g - l - ri - u - d))::double / count(*) / 255 as noise from {LAPLACE} where l is not null and ri is not null and u is not null and d is not null group by 1")
def noise(spark, sf_dir):
    return P.noise(V.pixels(spark, sf_dir), BY)


@query("jn8_neighbours", f"select vec_id, x, y, l as left_, ri as right_, u as up_, d as down_ from {LAPLACE}")
def neighbours(spark, sf_dir):
    near = P.with_neighbours(V.pixels(spark, sf_dir), BY, "g")
    return near.select("vec_id", "x", "y", *(F.col(c).alias(f"{c}_") for c in ("left", "right", "up", "down")))


@query("flt19_mask", f"select vec_id, x, y from {MASK} where inside")
def mask(spark, sf_dir):
    return masked(spark, sf_dir).where("inside").select("vec_id", "x", "y")


@query("agg13_mask_bounds", f"select vec_id, x, y, w, h from {MEASURED}")
def mask_bounds(spark, sf_dir):
    return P.mask_measures(masked(spark, sf_dir), BY).select("vec_id", "x", "y", "w", "h")


@query("agg14_mask_edges", f"select vec_id, edge_density from {MEASURED}")
def mask_edges(spark, sf_dir):
    return P.mask_measures(masked(spark, sf_dir), BY).select("vec_id", "edge_density")


@query("agg15_mask_complexity", f"select vec_id, round(complexity, 9) as complexity from {MEASURED}")
def mask_complexity(spark, sf_dir):
    return P.mask_measures(masked(spark, sf_dir), BY).select("vec_id", F.round("complexity", 9).alias("complexity"))


@query("agg17_mask_area", f"select vec_id, area from {MEASURED}")
def mask_area(spark, sf_dir):
    return P.mask_measures(masked(spark, sf_dir), BY).select("vec_id", "area")


@query("flt20_mask_type", f"select vec_id, case when complexity < 0.3 then 'vector' else 'raster' end as region_type from {MEASURED}")
def mask_type(spark, sf_dir):
    return P.mask_type(P.mask_measures(masked(spark, sf_dir), BY), 0.3).select("vec_id", "region_type")


@query("gen13_mask_features", f"select vec_id, area, x, y, w, h, case when complexity < 0.5 then 'vector' else 'raster' end as region_type, texture from {MEASURED} join (select vec_id, sqrt((count(*) * sum(g * g) - sum(g) * sum(g))::double) / count(*) / 255 as texture from {MASK} where inside group by 1) using (vec_id)")
def mask_features(spark, sf_dir):
    m = masked(spark, sf_dir)
    return P.mask_type(P.mask_measures(m, BY)).join(P.texture(m.where("inside"), BY), "vec_id").select("vec_id", "area", "x", "y", "w", "h", "region_type", "texture")


@query("agg16_histogram", "select vec_id, (r // 64)::bigint as r, (g // 64)::bigint as g, (b // 64)::bigint as b, (a // 64)::bigint as a, count(*) as n from v_rgba group by all")
def histogram(spark, sf_dir):
    coarse = V.rgba(spark, sf_dir).select("vec_id", *(T.div(F.col(c), 64).alias(c) for c in "rgba"))
    return P.histogram(coarse, BY)


@query("top1_dominant_colours", "select * from (select vec_id, row_number() over (partition by vec_id order by count(*) desc, r // 64, g // 64, b // 64, a // 64) as place, (r // 64)::bigint as r, (g // 64)::bigint as g, (b // 64)::bigint as b, (a // 64)::bigint as a, count(*) as n from v_rgba group by vec_id, r // 64, g // 64, b // 64, a // 64) where place <= 3")
def dominant_colours(spark, sf_dir):
    coarse = V.rgba(spark, sf_dir).select("vec_id", *(T.div(F.col(c), 64).alias(c) for c in "rgba"))
    return P.dominant_colours(coarse, BY).withColumn("place", F.col("place").cast("long"))


REGIONS = "(select vec_id, vec_id % 5 as x, vec_id % 3 as y, 3 as w, 4 as h from (select distinct vec_id from v_pixels))"


@query("jn6_pixels_in_regions", f"select p.vec_id, p.x, p.y from v_pixels p join {REGIONS} r on p.vec_id = r.vec_id and p.x >= r.x and p.x < r.x + r.w and p.y >= r.y and p.y < r.y + r.h")
def pixels_in_regions(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    regions = p.select("vec_id").distinct().select("vec_id", (F.col("vec_id") % 5).alias("x"), (F.col("vec_id") % 3).alias("y"), F.lit(3).alias("w"), F.lit(4).alias("h"))
    return P.inside_regions(p, regions, BY).select("vec_id", "x", "y")


@query("jn7_region_mask", "select vec_id, x, y, (y > 1 and y <= 6 and x < (6 - 1) * (y - 1) / 5.0 + 1) as inside from v_pixels")
def region_mask(spark, sf_dir):
    """Pixels inside one triangle, by ray casting on its edges."""
    from ..operators.contours import points_inside

    p = V.pixels(spark, sf_dir).select("vec_id", "x", "y")
    triangle = p.sparkSession.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 6.0, 6.0), (0, 2, 1.0, 6.0)], "contour_id long, seq int, x double, y double")
    code = F.col("vec_id") * 64 + F.col("y") * 8 + F.col("x")
    probes = p.select(code.alias("probe_id"), F.lit(0).cast("long").alias("contour_id"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    hit = points_inside(probes, triangle).select(F.col("probe_id"), F.lit(True).alias("hit"))
    return p.withColumn("probe_id", code).join(hit, "probe_id", "left").select("vec_id", "x", "y", F.coalesce("hit", F.lit(False)).alias("inside"))


SQL["jn7_region_mask"] = "select vec_id, x, y, ((case when (1 > y) <> (6 > y) and x < 5 * (y - 1) / 5.0 + 1 then 1 else 0 end) + (case when (6 > y) <> (1 > y) and x < 0 * (y - 6) / -5.0 + 1 then 1 else 0 end)) % 2 = 1 as inside from v_pixels"

LAYER = "(select vec_id, x, y, 255 - r as r, g, b // 2 as b, (a + 60) % 256 as a from v_rgba where (x + y) % 3 <> 0)"


def layer(spark, sf_dir):
    return V.rgba(spark, sf_dir).where("(x + y) % 3 <> 0").select("vec_id", "x", "y", (255 - F.col("r")).alias("r"), "g", T.div(F.col("b"), 2).cast("int").alias("b"), ((F.col("a") + 60) % 256).alias("a"))


def mixed_sql(c: str, mode: str, opacity: float = 0.8) -> str:
    s, t = f"(s.{c} / 255.0::double)", f"(t.{c} / 255.0::double)"
    m = {"normal": s, "multiply": f"({s} * {t})", "screen": f"(1 - (1 - {s}) * (1 - {t}))", "overlay": f"(case when {t} < 0.5 then 2 * {s} * {t} else 1 - 2 * (1 - {s}) * (1 - {t}) end)"}[mode]
    return f"case when s.a is null or s.a = 0 then t.{c} else floor({m} * 255 * (s.a / 255.0::double * {opacity!r}::double) + t.{c} * (1 - (s.a / 255.0::double * {opacity!r}::double)) + 1e-9)::int end as {c}"


def composite_query(mode: str):
    def run(spark, sf_dir):
        return P.composite(V.rgba(spark, sf_dir), layer(spark, sf_dir), BY, 0.8, mode)

    return run


for _name, _mode in (("jn12_composite", "normal"), ("px7_multiply", "multiply"), ("px7_screen", "screen"), ("px7_overlay", "overlay")):
    QUERIES[_name] = composite_query(_mode)
    SQL[_name] = f"select t.vec_id, t.x, t.y, {', '.join(mixed_sql(c, _mode) for c in 'rgb')}, greatest(t.a, coalesce(s.a, 0))::int as a from v_rgba t left join {LAYER} s on s.vec_id = t.vec_id and s.x = t.x and s.y = t.y"
UPPER_LAYER = "(select vec_id, x, y, g as r, b as g, r as b, (a * 3 + 90) % 256 as a from v_rgba where x % 2 = 0)"


@query("px2_layer_composite", f"with lower as ({SQL['jn12_composite']}) select t.vec_id, t.x, t.y, {', '.join(mixed_sql(c, 'multiply', 0.5) for c in 'rgb')}, greatest(t.a, coalesce(s.a, 0))::int as a from lower t left join {UPPER_LAYER} s on s.vec_id = t.vec_id and s.x = t.x and s.y = t.y")
def layer_composite(spark, sf_dir):
    """Two layers over an image in their order, each with its own mode and opacity."""
    upper = V.rgba(spark, sf_dir).where("x % 2 = 0").select("vec_id", "x", "y", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), ((F.col("a") * 3 + 90) % 256).alias("a"))
    return P.composite(P.composite(V.rgba(spark, sf_dir), layer(spark, sf_dir), BY, 0.8, "normal"), upper, BY, 0.5, "multiply")


@query("px1_alpha_blend", "select t.vec_id, t.x, t.y, " + ", ".join(f"floor(s.{c} * (s.a / 255.0::double * 0.5::double) + t.{c} * (1 - (s.a / 255.0::double * 0.5::double)))::int as {c}" for c in "rgb") + f", floor(least(s.a * 0.5::double + t.a * (1 - 0.5::double), 255.0::double))::int as a from v_rgba t join {LAYER} s on s.vec_id = t.vec_id and s.x = t.x and s.y = t.y")
def alpha_blend(spark, sf_dir):
    t, s = V.rgba(spark, sf_dir).alias("t"), layer(spark, sf_dir).alias("s")
    on = (F.col("t.vec_id") == F.col("s.vec_id")) & (F.col("t.x") == F.col("s.x")) & (F.col("t.y") == F.col("s.y"))
    return t.join(s, on).select("t.vec_id", "t.x", "t.y", *P.blend("s", "t", 0.5))


@query("px3_lab", "select vec_id, x, y, round(116 * (0.2126729 * power(r / 255.0::double, 2) + 0.7151522 * power(g / 255.0::double, 2) + 0.0721750 * power(b / 255.0::double, 2)) - 16, 6) as l from v_rgba")
def lab(spark, sf_dir):
    return P.to_lab(V.rgba(spark, sf_dir)).select("vec_id", "x", "y", F.round("l", 6).alias("l"))


@query("px4_gaussian_kernel", "select p_partkey, k::int as k, round(exp(-k * k / (2 * s * s)) / sum(exp(-k * k / (2 * s * s))) over (partition by p_partkey), 9) as weight from (select p_partkey, s, unnest(range(-h, h + 1)) as k from (select p_partkey, s, (greatest(floor(6 * s)::int, 3) | 1) // 2 as h from (select p_partkey, 0.5::double + (p_size % 4) * 0.5::double as s from part)))")
def gaussian_kernel(spark, sf_dir):
    """A kernel for each part, as wide as its blur asks for."""
    blurs = V.table(spark, sf_dir, "part").select("p_partkey", (F.lit(0.5) + F.col("p_size") % 4 * F.lit(0.5)).alias("sigma"))
    return P.gaussian_kernels(blurs, ["p_partkey"]).select("p_partkey", "k", F.round("weight", 9).alias("weight"))


TAPS = "(values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(k, w)"


@query("win10_blur", f"with h as (select p.vec_id, p.x, p.y, (sum(t.w * q.g) // 16)::int as g from v_pixels p, {TAPS} join v_pixels q on true where q.vec_id = p.vec_id and q.y = p.y and q.x = least(greatest(p.x + t.k, 0), 7) group by all) select p.vec_id, p.x, p.y, (sum(t.w * q.g) // 16)::int as g from h p, {TAPS} join h q on true where q.vec_id = p.vec_id and q.x = p.x and q.y = least(greatest(p.y + t.k, 0), 7) group by all")
def blur(spark, sf_dir):
    return P.blur(V.pixels(spark, sf_dir), BY, [1, 4, 6, 4, 1])


@query("px5_brightness", "select vec_id, x, y, " + ", ".join(f"least(greatest({c} + 70, 0), 255)::int as {c}" for c in "rgb") + " from v_rgba")
def brightness(spark, sf_dir):
    return P.brightness(V.rgba(spark, sf_dir), 70).select("vec_id", "x", "y", "r", "g", "b")


@query("px6_preview_size", "select p_partkey, greatest(floor(w * least(1.0, 256.0::double / greatest(w, h))), 1)::int as pw, greatest(floor(h * least(1.0, 256.0::double / greatest(w, h))), 1)::int as ph from (select p_partkey, p_partkey * 37 % 3000 + 1 as w, p_partkey * 53 % 2000 + 1 as h from part)")
def preview_size(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", *P.preview_size(F.col("p_partkey") * 37 % 3000 + 1, F.col("p_partkey") * 53 % 2000 + 1))


@query("gen2_box_mean", "select vec_id, x // 2 as x, y // 2 as y, (sum(g) // count(*))::int as g from v_pixels group by vec_id, x // 2, y // 2")
def box_mean(spark, sf_dir):
    return P.box_mean(V.pixels(spark, sf_dir), BY, 1)


SMALL = "(select vec_id, x // 2 as x, y // 2 as y, (sum(g) // count(*))::int as g from v_pixels where x < 6 group by vec_id, x // 2, y // 2)"


@query("px15_nearest_enlarged", f"select p.vec_id, p.x, p.y, coalesce(s.g, 0) as g from v_pixels p left join {SMALL} s on s.vec_id = p.vec_id and s.x = p.x // 2 and s.y = p.y // 2")
def nearest_enlarged(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    return P.enlarge(p.select("vec_id", "x", "y"), P.box_mean(p.where("x < 6"), BY, 1), BY, 1)


@query("jn13_decode_region", f"select v as vec_id, a.x::int as x, b.y::int as y, coalesce(s.g, 0) as g from (select distinct vec_id as v from v_pixels), range(1, 10) a(x), range(2, 11) b(y) left join {SMALL} s on s.vec_id = v and s.x = a.x // 2 and s.y = b.y // 2")
def decode_region(spark, sf_dir):
    """A rectangle of level-0 pixels from the tiles of level 1; what no tile has is transparent."""
    p = V.pixels(spark, sf_dir)
    rect = p.select("vec_id").distinct().withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("y", F.explode(F.sequence(F.lit(2), F.lit(10))))
    return P.enlarge(rect, P.box_mean(p.where("x < 6"), BY, 1), BY, 1)


@query("agg24_sample_mean", "select vec_id, (x // 2)::bigint as x, (y // 2)::bigint as y, sum(g)::double / count(*) as g from v_pixels group by vec_id, x // 2, y // 2")
def sample_mean(spark, sf_dir):
    """Each pixel as the mean of its samples."""
    return V.pixels(spark, sf_dir).groupBy("vec_id", T.div(F.col("x"), 2).alias("x"), T.div(F.col("y"), 2).alias("y")).agg((F.sum("g").cast("double") / F.count("*")).alias("g"))


@query("px11_smoothstep", "select vec_id, x, y, round(t * t * (3 - 2 * t), 9) as cover from (select vec_id, x, y, least(greatest((g - 64) / 128.0::double, 0.0::double), 1.0::double) as t from v_pixels)")
def smoothstep(spark, sf_dir):
    return V.pixels(spark, sf_dir).select("vec_id", "x", "y", F.round(P.smoothstep(F.col("g"), 64, 192), 9).alias("cover"))


@query("px12_filled_boxes", "select p.vec_id, x, y, count(*) as n from v_pixels p join (select distinct vec_id, k, (vec_id + k) % 6 as bx, k % 4 as by_, 2 + k as w, 3 as h from v_pixels, range(3) t(k)) b on b.vec_id = p.vec_id and x >= bx and x < bx + w and y >= by_ and y < by_ + h group by all")
def filled_boxes(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    boxes = p.select("vec_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    boxes = boxes.select("vec_id", ((F.col("vec_id") + F.col("k")) % 6).alias("bx"), (F.col("k") % 4).alias("by_"), (F.col("k") + 2).alias("w"), F.lit(3).alias("h"))
    return P.fill_boxes(p, boxes, BY)


@query("px13_centre_colour", "select vec_id, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b, a / 255.0::double as a from v_rgba where x = 4 and y = 4")
def centre_colour(spark, sf_dir):
    return P.centre_colour(V.rgba(spark, sf_dir), BY)


@query("px14_luma", "select vec_id, x, y, round(0.299::double * r + 0.587::double * g + 0.114::double * b, 6) as luma from v_rgba")
def luma(spark, sf_dir):
    return V.rgba(spark, sf_dir).select("vec_id", "x", "y", F.round(P.luma(), 6).alias("luma"))


@query("gen3_segment_dispatch", "select vec_id, case vec_id % 3 when 0 then 'vector' when 1 then 'raster' else case when count(*) filter (g > 150)::double / count(*) > 0.1 then 'vector' else 'raster' end end as region_type from v_pixels group by vec_id")
def segment_dispatch(spark, sf_dir):
    """Regions by method: all vector, all raster, or by edge density."""
    whole = P.block_type(P.block_density(V.pixels(spark, sf_dir).withColumn("edge", F.col("g") > 150), BY, 8))
    return whole.select("vec_id", F.when(F.col("vec_id") % 3 == 0, "vector").when(F.col("vec_id") % 3 == 1, "raster").otherwise(F.col("region_type")).alias("region_type"))


@query("gen5_pyramid_index", "with kept as (select vec_id, (x // 4)::bigint as tx, (y // 4)::bigint as ty, count(*) filter (a > 0) as size from v_rgba group by vec_id, x // 4, y // 4 having bool_or(a > 0)) select vec_id, tx, ty, size, coalesce(sum(size) over (partition by vec_id order by ty, tx rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ from kept")
def pyramid_index(spark, sf_dir):
    """Index entries of the tiles that are not empty, with running offsets."""
    cells = V.rgba(spark, sf_dir).groupBy("vec_id", T.div(F.col("x"), 4).alias("x"), T.div(F.col("y"), 4).alias("y")).agg(F.count_if(F.col("a") > 0).alias("size")).where("size > 0")
    return T.with_offsets(cells.withColumn("level", F.lit(0)), ["vec_id"]).select("vec_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "size", F.col("offset").alias("offset_"))


@query("gen9_components", "with recursive m as (select vec_id, x, y, y * 65536 + x as c from v_pixels where g > 140), r as (select vec_id, c as start, c, x, y from m union select r.vec_id, r.start, m.c, m.x, m.y from r join m on m.vec_id = r.vec_id and abs(m.x - r.x) <= 1 and abs(m.y - r.y) <= 1) select vec_id, x, y, min(start)::bigint as label from r group by all")
def components(spark, sf_dir):
    return P.labels8(V.pixels(spark, sf_dir), BY, 140)
