"""Queries on tile pyramids: coordinates, grids, lookups, validation, offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import tiles as T
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


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of one file per part: sizes and zoom from its columns, some of them wrong on purpose."""
    p = V.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size = F.when(k % 17 == 0, 500).otherwise(F.call_function("shiftleft", F.lit(64), (k % 4).cast("int")))
    return p.select(
        k.alias("file_id"), F.when(k % 29 == 0, 2).otherwise(1).cast("long").alias("version"), F.when(k % 31 == 0, 0).otherwise(k * 37 % 3000 + 1).cast("long").alias("width"),
        F.when(k % 37 == 0, 70000).otherwise(k * 53 % 2000 + 1).cast("long").alias("height"), size.cast("long").alias("tile_size"), F.when(k % 41 == 0, 21).otherwise(k % 8).cast("int").alias("max_zoom_level"),
    )


def good_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).where(T.metadata_violation().isNull())


META = """(select p_partkey as file_id, (case when p_partkey % 29 = 0 then 2 else 1 end)::bigint as version,
  (case when p_partkey % 31 = 0 then 0 else p_partkey * 37 % 3000 + 1 end)::bigint as width, (case when p_partkey % 37 = 0 then 70000 else p_partkey * 53 % 2000 + 1 end)::bigint as height,
  (case when p_partkey % 17 = 0 then 500 else 64 << (p_partkey % 4)::int end)::bigint as tile_size, (case when p_partkey % 41 = 0 then 21 else p_partkey % 8 end)::int as max_zoom_level from part)"""
GOOD = f"(select * from {META} where version = 1 and width > 0 and height <= 65536 and tile_size <> 500 and max_zoom_level <= 20)"
CEIL = "((width + (tile_size << level) - 1) // (tile_size << level)), ((height + (tile_size << level) - 1) // (tile_size << level))"
RECTS = [(k, level, 40 * k, 7 * k, 300 + k, 20 + k) for k in range(12) for level in range(V.LEVELS)]
RECT_SQL = f"(select k as rect, level, 40 * k as rx, 7 * k as ry, 300 + k as rw, 20 + k as rh from range(12) a(k), range({V.LEVELS}) b(level))"


def rects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECTS, "rect long, level int, rx long, ry long, rw long, rh long")


HIT = f"{RECT_SQL} r join v_tiles t on t.level = r.level and t.x between (rx // (1 << r.level)) // 64 and ((rx + rw - 1) // (1 << r.level)) // 64 and t.y between (ry // (1 << r.level)) // 64 and ((ry + rh - 1) // (1 << r.level)) // 64"
OFFSETS = "(select *, coalesce(sum(size) over (order by level, y, x rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ from v_tiles)"


@query("slice0_region_tiles", f"select r.rect, t.level, t.x, t.y, o.size, o.offset_ from {HIT} join {OFFSETS} o on o.level = t.level and o.x = t.x and o.y = t.y")
def region_tiles(spark, sf_dir):
    """Tiles that rectangles touch on each level, with their offsets."""
    index = T.bucketed_offsets(V.tiles(spark, sf_dir)).withColumnRenamed("offset", "offset_")
    return T.candidates(rects(spark), V.TILE).join(index, T.KEY).select("rect", *T.KEY, "size", "offset_")


@query("prj1_pixel_to_tile", "select l_orderkey, l_linenumber, level, (l_partkey // (1 << level)) // 64 as tx, (l_suppkey // (1 << level)) // 64 as ty from lineitem, range(4) t(level)")
def pixel_to_tile(spark, sf_dir):
    items = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("level"))
    return items.select("l_orderkey", "l_linenumber", "level", T.pixel_to_tile(F.col("l_partkey"), F.col("level"), 64).alias("tx"), T.pixel_to_tile(F.col("l_suppkey"), F.col("level"), 64).alias("ty"))


@query("prj2_tile_bounds", "select level, x, y, x * (64 << level) as px, y * (64 << level) as py, (64 << level)::bigint as pw, (64 << level)::bigint as ph from v_tiles")
def tile_bounds(spark, sf_dir):
    return V.tiles(spark, sf_dir).select(*T.KEY, *T.tile_bounds(F.col("x"), F.col("y"), F.col("level"), 64))


@query("prj3_levels", f"select file_id, unnest(range(max_zoom_level + 1))::int as level from {GOOD}")
def zoom_levels(spark, sf_dir):
    return T.levels(good_meta(spark, sf_dir)).select("file_id", "level")


@query("prj4_tile_count", f"select file_id, sum(a * b)::bigint as tiles from (select file_id, ({CEIL.split('), (')[0]})) as a, (({CEIL.split('), (')[1]}) as b from (select *, unnest(range(max_zoom_level + 1))::int as level from {GOOD})) group by 1")
def tile_count(spark, sf_dir):
    return T.tile_count(good_meta(spark, sf_dir))


@query("prj5_regions", f"select file_id, x, y, least(512, width - x)::bigint as w, least(512, height - y)::bigint as h from (select *, unnest(range(0, width, 512)) as x from (select *, unnest(range(0, height, 512)) as y from {GOOD}))")
def regions(spark, sf_dir):
    return T.regions(good_meta(spark, sf_dir), 512)


CENTRES = "(select distinct client, (x::bigint // 64)::bigint as cx, (client % 5)::bigint as cy from v_viewports)"
RINGS = f"(select client, cx, cy, greatest(abs(dx), abs(dy)) as radius, dx, dy, cx + dx as x, cy + dy as y from {CENTRES}, range(-9, 10) a(dx), range(-9, 10) b(dy) where cx + dx >= 0 and cy + dy >= 0)"


def centres(spark, sf_dir):
    v = V.viewports(spark, sf_dir)
    return v.select("client", T.div(F.col("x").cast("long"), 64).alias("cx"), (F.col("client") % 5).cast("long").alias("cy")).distinct()


@query("prj6_visible_tiles", f"select client, radius, dx, dy, x, y from {RINGS}")
def visible(spark, sf_dir):
    return T.rings(centres(spark, sf_dir)).select("client", F.col("radius").cast("long").alias("radius"), F.col("dx").cast("long").alias("dx"), F.col("dy").cast("long").alias("dy"), "x", "y")


@query("top7_spiral_order", f"select client, row_number() over (partition by client, cx order by radius, dx, dy) as place, cx, x, y from {RINGS}")
def spiral(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("client", "cx").orderBy("radius", "dx", "dy")
    return T.rings(centres(spark, sf_dir)).select("client", F.row_number().over(order).cast("long").alias("place"), "cx", "x", "y")


@query("prj12_placement", f"select r.rect, t.level, t.x, t.y, greatest(rx - t.x * (64 << t.level), 0)::bigint as src_x, greatest(t.x * (64 << t.level) - rx, 0)::bigint as dst_x, greatest(ry - t.y * (64 << t.level), 0)::bigint as src_y, greatest(t.y * (64 << t.level) - ry, 0)::bigint as dst_y, least((64 << t.level) - greatest(rx - t.x * (64 << t.level), 0), rw - greatest(t.x * (64 << t.level) - rx, 0))::bigint as cw, least((64 << t.level) - greatest(ry - t.y * (64 << t.level), 0), rh - greatest(t.y * (64 << t.level) - ry, 0))::bigint as ch from {HIT}")
def placement(spark, sf_dir):
    hit = T.intersecting(rects(spark), V.tiles(spark, sf_dir), 64)
    return T.placement(hit, 64).select("rect", *T.KEY, "src_x", "dst_x", "src_y", "dst_y", "cw", "ch")


@query("prj14_metadata", f"select file_id, width, height, tile_size, max_zoom_level from {META}")
def metadata(spark, sf_dir):
    return meta(spark, sf_dir).select("file_id", "width", "height", "tile_size", "max_zoom_level")


SPEC = "(select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'bad' || l_linenumber when 1 then l_linenumber || '/' || l_partkey || '_' || l_suppkey else l_linenumber || '/' || l_partkey end as spec from lineitem)"


@query("prj15_tile_spec", rf"select spec, case when spec ~ '^\d+/\d+_\d+$' then split_part(spec, '/', 1)::int end as level, case when spec ~ '^\d+/\d+_\d+$' then split_part(split_part(spec, '/', 2), '_', 1)::int end as x, case when spec ~ '^\d+/\d+_\d+$' then split_part(spec, '_', 2)::int end as y from {SPEC}")
def tile_spec(spark, sf_dir):
    n, p, s = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    kind = F.col("l_linenumber") % 3
    spec = F.when(kind == 0, F.concat(F.lit("bad"), n)).when(kind == 1, F.concat(n, F.lit("/"), p, F.lit("_"), s)).otherwise(F.concat(n, F.lit("/"), p))
    return V.table(spark, sf_dir, "lineitem").select(spec.alias("spec")).select("spec", *T.parse_spec(F.col("spec")))


@query("flt5_has_tile", "select level, x, y from v_tiles where (x + y + level) % 3 = 0")
def has_tile(spark, sf_dir):
    held = V.tiles(spark, sf_dir)
    return held.where("(x + y + level) % 3 = 0").select(*T.KEY).join(held, T.KEY, "left_semi")


@query("flt7_metadata_rules", f"select file_id, case when version > 1 then 'version' when width <= 0 or height <= 0 then 'zero_dimension' when width > 65536 or height > 65536 then 'dimension_too_large' when tile_size & (tile_size - 1) <> 0 then 'tile_size_not_power_of_two' when max_zoom_level > 20 then 'zoom_too_high' end as code from {META}")
def metadata_rules(spark, sf_dir):
    return meta(spark, sf_dir).select("file_id", T.metadata_violation().alias("code"))


def file_index(spark, sf_dir):
    """Index entries of files, some outside their pyramid, dealt as the files are when they are checked."""
    g = T.grid(T.by_file(meta(spark, sf_dir)).where(T.metadata_violation().isNull()), "ceil")
    return g.select("file_id", F.when((F.col("x") + F.col("y")) % 7 == 3, F.col("level") + 20).otherwise(F.col("level")).cast("int").alias("level"), (F.col("x") + F.when(F.col("y") % 11 == 5, 1000).otherwise(0)).alias("x"), "y")


GRID = f"(select file_id, level, width, height, tile_size, max_zoom_level, x, unnest(range(0, b)) as y from (select *, unnest(range(0, a)) as x from (select *, (width + (tile_size << level) - 1) // (tile_size << level) as a, (height + (tile_size << level) - 1) // (tile_size << level) as b from (select *, unnest(range(max_zoom_level + 1))::int as level from {GOOD}))))"
INDEX = f"(select file_id, (case when (x + y) % 7 = 3 then level + 20 else level end)::int as level, x + (case when y % 11 = 5 then 1000 else 0 end) as x, y, width, height, tile_size, max_zoom_level from {GRID})"
CODE = "case when level > max_zoom_level then 'level' when x >= (width + (tile_size << level) - 1) // (tile_size << level) then 'x' when y >= (height + (tile_size << level) - 1) // (tile_size << level) then 'y' end"


@query("flt8_index_rules", f"select * from (select file_id, level, x, y, {CODE} as code from {INDEX}) where code is not null")
def index_rules(spark, sf_dir):
    return T.index_violations(file_index(spark, sf_dir), meta(spark, sf_dir))


@query("flt10_count_rule", f"with c as (select file_id, count(*) * (1 + file_id % 2) as held, count(*) as tiles from {GRID} group by file_id) select file_id, tiles::bigint as tiles, held::bigint as held from c where held > tiles")
def count_rule(spark, sf_dir):
    index = T.grid(good_meta(spark, sf_dir), "ceil")
    twice = index.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_id") % 2)))
    return T.count_violations(twice, meta(spark, sf_dir))


@query("flt12_validate", f"select file_id, count(*) as violations from (select file_id from {META} where not (version = 1 and width > 0 and height <= 65536 and tile_size <> 500 and max_zoom_level <= 20) union all select file_id from (select file_id, {CODE} as code from {INDEX}) where code is not null) group by 1")
def validate(spark, sf_dir):
    held = meta(spark, sf_dir)
    rules = held.where(T.metadata_violation().isNotNull()).select("file_id")
    return rules.unionAll(T.index_violations(file_index(spark, sf_dir), held).select("file_id")).groupBy("file_id").agg(F.count("*").alias("violations"))


ERROR_CODES = ("tile_not_found", "network", "timeout", "checksum", "invalid_header", "io")


@query("flt23_error_classes", f"select event_id, code, code in ('tile_not_found', 'network', 'timeout') as recoverable, code in ('checksum', 'invalid_header') as security from (select event_id, {list(ERROR_CODES)}[event_id % 6 + 1] as code from events)")
def error_classes(spark, sf_dir):
    """What can be done about the error of each event."""
    code = F.element_at(F.array(*map(F.lit, ERROR_CODES)), (F.col("event_id") % 6 + 1).cast("int"))
    codes = V.table(spark, sf_dir, "events").select("event_id", code.alias("code"))
    return codes.select("event_id", "code", F.col("code").isin(*scalars.RECOVERABLE).alias("recoverable"), F.col("code").isin(*scalars.SECURITY).alias("security"))


@query("jn1_tile_lookup", "select l_orderkey, l_linenumber, t.size from lineitem join v_tiles t on t.level = 2 and t.x = (l_partkey // 4) // 64 and t.y = (l_suppkey // 4) // 64")
def tile_lookup(spark, sf_dir):
    asked = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(2).alias("level"), T.pixel_to_tile(F.col("l_partkey"), F.lit(2), 64).alias("x"), T.pixel_to_tile(F.col("l_suppkey"), F.lit(2), 64).alias("y"))
    return asked.join(V.tiles(spark, sf_dir), T.KEY).select("l_orderkey", "l_linenumber", "size")


@query("jn2_intersecting_tiles", f"select r.rect, t.level, t.x, t.y from {HIT}")
def intersecting_tiles(spark, sf_dir):
    return T.intersecting(rects(spark), V.tiles(spark, sf_dir), 64).select("rect", *T.KEY)


@query("jn3_existing_tiles", "select level, x, y from v_tiles where level = 1")
def existing_tiles(spark, sf_dir):
    held = V.tiles(spark, sf_dir).where("level = 1")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c)))
    extent = held.agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    cells = extent.withColumn("x", up_to("right")).withColumn("y", up_to("bottom")).select(F.lit(1).alias("level"), "x", "y")
    return cells.join(held, T.KEY, "left_semi")


QUALITY = "(select level, x, y, q, q * 10 + x as image from v_tiles, range(5) t(q) where (x + y + q) % 2 = 0)"


@query("jn10_best_quality", f"select level, x, y, max(q) as quality, max(q) * 10 + x as image from {QUALITY} group by level, x, y")
def best_quality(spark, sf_dir):
    held = V.tiles(spark, sf_dir).withColumn("quality", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).where("(x + y + quality) % 2 = 0")
    held = held.select(*T.KEY, "quality", (F.col("quality") * 10 + F.col("x")).alias("image"))
    return held.groupBy(*T.KEY).agg(F.max("quality").alias("quality"), F.max_by("image", "quality").alias("image"))


@query("jn15_one_tile", "select p_partkey, x, y, least(64, w // (1 << level) - x * 64)::bigint as tw, least(64, h // (1 << level) - y * 64)::bigint as th from (select *, (p_partkey % 5) % (w // (1 << level) // 64 + 1) as x, (p_partkey % 3) % (h // (1 << level) // 64 + 1) as y from (select p_partkey, (p_partkey % 3)::int as level, 700 + p_size * 9::bigint as w, 650 + p_partkey % 411 as h from part))")
def one_tile(spark, sf_dir):
    """For each image the pixels of one of its tiles that lie in it."""
    k, level = F.col("p_partkey"), F.col("level")
    sizes = V.table(spark, sf_dir, "part").select(k, (k % 3).cast("int").alias("level"), (F.lit(700) + F.col("p_size") * F.lit(9).cast("long")).alias("width"), (F.lit(650) + k % 411).alias("height"), F.lit(64).cast("long").alias("tile_size"))
    tiles = lambda c: T.div(T.div(F.col(c), T.scale(level)), 64) + 1
    asked = sizes.withColumns({"x": k % 5 % tiles("width"), "y": k % 3 % tiles("height")})
    return T.tile_size_on_level(asked).select("p_partkey", "x", "y", "tw", "th")


@query("win1_offsets", f"select level, x, y, size, offset_ from {OFFSETS}")
def offsets(spark, sf_dir):
    return T.bucketed_offsets(V.tiles(spark, sf_dir)).select(*T.KEY, "size", F.col("offset").alias("offset_"))


@query("win1_offsets_by_level", "select level, x, y, coalesce(sum(size) over (partition by level order by y, x rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ from v_tiles")
def level_offsets(spark, sf_dir):
    return T.with_offsets(V.tiles(spark, sf_dir), ["level"]).select(*T.KEY, F.col("offset").alias("offset_"))


@query("agg20_tile_bytes", "select sum(size)::bigint as bytes from v_tiles")
def tile_bytes(spark, sf_dir):
    return V.tiles(spark, sf_dir).agg(F.sum("size").alias("bytes"))


@query("agg21_level_counts", "select level, count(*) as tiles, sum(size)::bigint as bytes from v_tiles group by rollup (level)")
def level_counts(spark, sf_dir):
    return T.level_counts(V.tiles(spark, sf_dir))


@query("agg23_compression_ratio", "select level, sum(size * 3)::double / sum(size) as ratio from v_tiles group by level")
def compression_ratio(spark, sf_dir):
    return V.tiles(spark, sf_dir).groupBy("level").agg((F.sum(F.col("size") * 3).cast("double") / F.sum("size")).alias("ratio"))


@query("set1_pyramid_union", "select level, x, y from v_tiles")
def pyramid_union(spark, sf_dir):
    held = V.tiles(spark, sf_dir).select(*T.KEY)
    out = held.where("level = 0")
    for level in range(1, V.LEVELS):
        out = out.unionByName(held.where(F.col("level") == level))
    return out


@query("set4_upsert", "select user_id, event_type, max(event_id) as event_id, arg_max(floor(value)::bigint, event_id) as v from events group by all")
def upsert(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor("value").alias("v"))
    return T.latest(e, ["user_id", "event_type"], "event_id")


@query("gen1_pyramid_tiles", f"select file_id, level, count(*) as tiles from (select file_id, level, x, unnest(range(0, b)) as y from (select *, unnest(range(0, a)) as x from (select *, ((width // (1 << level)) + tile_size - 1) // tile_size as a, ((height // (1 << level)) + tile_size - 1) // tile_size as b from (select *, unnest(range(max_zoom_level + 1))::int as level from {GOOD})))) group by all")
def pyramid_tiles(spark, sf_dir):
    return T.grid(good_meta(spark, sf_dir), "floor").groupBy("file_id", "level").agg(F.count("*").alias("tiles"))


@query("gen2_level_grid", f"select file_id, x, y, least(tile_size, width // 4 - x * tile_size)::bigint as tw, least(tile_size, height // 4 - y * tile_size)::bigint as th from (select *, unnest(range(0, ((height // 4) + tile_size - 1) // tile_size)) as y from (select *, unnest(range(0, ((width // 4) + tile_size - 1) // tile_size)) as x from {GOOD} where max_zoom_level >= 2))")
def level_grid(spark, sf_dir):
    m = good_meta(spark, sf_dir)
    g = T.grid(m, "floor").where("level = 2").join(m.drop("max_zoom_level", "version"), "file_id")
    return T.tile_size_on_level(g).select("file_id", "x", "y", "tw", "th")


@query("str_tile_priority", "select level, x, y, 1.0 / (level + 1) as priority from v_tiles")
def tile_priority(spark, sf_dir):
    return V.tiles(spark, sf_dir).select("level", "x", "y", (F.lit(1.0) / (F.col("level") + 1)).alias("priority"))


@query("str2_viewport_tiles", f"select client, x, y, q as quality from {RINGS}, range(5) t(q) where radius <= 2")
def viewport_tiles(spark, sf_dir):
    seen = T.rings(centres(spark, sf_dir), 2)
    return seen.select("client", "x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("quality"))


@query("top8_quality_order", "select user_id, quality, row_number() over (partition by user_id order by r) - 1 as place from (select distinct user_id, ['full', 'high', 'medium', 'low', 'thumbnail'][event_id % 5 + 1] as quality, event_id % 5 as r from events)")
def quality_order(spark, sf_dir):
    """The qualities that each client has asked for, the best first."""
    from ..operators.metrics import QUALITY_ORDER

    best = list(reversed(QUALITY_ORDER))
    asked = V.table(spark, sf_dir, "events").select("user_id", F.element_at(F.array(*map(F.lit, best)), (F.col("event_id") % 5 + 1).cast("int")).alias("quality")).distinct()
    order = Window.partitionBy("user_id").orderBy(F.array_position(F.array(*map(F.lit, best)), F.col("quality")))
    return asked.select("user_id", "quality", (F.row_number().over(order) - 1).cast("long").alias("place"))
