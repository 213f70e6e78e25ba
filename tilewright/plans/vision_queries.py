"""Queries on whole images: edges, walks, resampling. Their order-dependent results have no SQL, so tests hold them to plain versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contours as C
from ..operators import pixels as P
from ..operators import tiled, vision
from ..operators.tiles import div
from ..streaming import cache, viewports
from . import views as V


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-element embedding as an 8 x 8 image row."""
    level = lambda v: F.lpad(F.hex(F.floor((v.cast("double") + 1) * 127.5)), 2, "0")
    full = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return full.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform("embedding", level), "")).alias("data"))


def canny_edges(spark, sf_dir):
    """Edge pixels per image."""
    return vision.canny(grey_images(spark, sf_dir), 20, 40).select("id", (F.length(F.regexp_replace(F.hex("data"), "00", "")) / 2).cast("int").alias("edges"))


def auto_segments(spark, sf_dir):
    """Region types of blocks by the share of edge pixels, from Canny edges of each image."""
    edges = vision.canny(grey_images(spark, sf_dir), 20, 40).select(F.col("id").alias("vec_id"), "data", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    marked = edges.select("vec_id", (F.col("k") % 8).alias("x"), div(F.col("k"), 8).alias("y"), (F.hex(F.substring(F.col("data"), F.col("k") + 1, F.lit(1))) == "FF").alias("edge"))
    return P.block_type(P.block_density(marked, ["vec_id"], 4))


def contour_walks(spark, sf_dir):
    return vision.contour_walks(grey_images(spark, sf_dir), 140)


def contour_paths(spark, sf_dir):
    """Drawing commands of the walks over the edges of each image."""
    walked = vision.contour_walks(vision.canny(grey_images(spark, sf_dir), 20, 40))
    return C.path_commands(walked.withColumn("contour_id", F.col("id") * 4096 + F.col("contour_id")).drop("id"))


def lanczos_level(spark, sf_dir):
    return vision.lanczos(grey_images(spark, sf_dir), 1).select("id", "width", "height", F.hex("data").alias("data"))


def mosaics(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    """``tiled.TILED``: the images of 64 consecutive ids side by side, as one of 64 x 64 pixels in tiles of 16; ids that lack leave zeros."""
    p = V.pixels(spark, sf_dir)
    k = F.col("vec_id") % 64
    cells = p.select(div(F.col("vec_id"), 64).alias("id"), (k % 8 * 8 + F.col("x")).alias("x"), (div(k, 8) * 8 + F.col("y")).alias("y"), "g")
    places = F.sequence(F.lit(0), F.lit(64 // side - 1))
    tiles = cells.select("id").distinct().withColumn("tx", F.explode(places)).withColumn("ty", F.explode(places))
    held = cells.groupBy("id", div(F.col("x"), side).cast("int").alias("tx"), div(F.col("y"), side).cast("int").alias("ty")).agg(F.collect_list(F.struct((F.col("y") % side * side + F.col("x") % side).cast("int").alias("k"), "g")).alias("cells"))
    spread = tiles.join(held, ["id", "tx", "ty"], "left").withColumn("m", F.map_from_entries(F.coalesce("cells", F.array().cast("array<struct<k: int, g: int>>"))))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("long")), 2, "0")), ""))
    return spread.select("id", "tx", "ty", F.lit(side).alias("width"), F.lit(side).alias("height"), data.alias("data"))


def tiled_edges(spark, sf_dir):
    """Edge pixels of mosaics that no row holds whole, by tile."""
    return tiled.canny(mosaics(spark, sf_dir), 16, 20, 40).select("id", "tx", "ty", (F.length(F.regexp_replace(F.hex("data"), "00", "")) / 2).cast("int").alias("edges"))


def cache_stream(spark, sf_dir):
    return cache.last_stats(spark, sf_dir)


def viewport_stream(spark, sf_dir):
    """The best quality that each tile of each view has got, from two streams."""
    found = viewports.last_views(spark, sf_dir)
    return found.select("client", "view", "tile", "quality", F.unix_micros("arrived").alias("arrived_us"), "steps")


VIEWS = "(select user_id as client, event_id as view, epoch_us(ts) as us, floor(value * 100)::bigint % 400 as x from events where event_id % 2 = 0)"
ARRIVALS = "(select user_id as client, floor(value * 100)::bigint % 9 as tile, event_id % 5 as quality, epoch_us(ts) as us from events where event_id % 2 = 1)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gen4_auto_segments": auto_segments, "gen10_canny": canny_edges, "gen10_tiled_edges": tiled_edges, "gen8_contour_walks": contour_walks, "gen7_contour_paths": contour_paths, "gen2_lanczos_level": lanczos_level, "str10_cache_stream": cache_stream, "str3_viewport_stream": viewport_stream,
}
SQL: dict[str, str] = {
    "str3_viewport_stream": f"""with shown as (select v.client, v.view, a.tile, a.quality, a.us, max(a.quality) over (partition by v.client, v.view, a.tile order by a.us, a.quality desc rows between unbounded preceding and 1 preceding) as before
  from {VIEWS} v join {ARRIVALS} a on a.client = v.client and a.tile between v.x // 64 and (v.x + 99) // 64 + 1 and a.us between v.us and v.us + 43200000000)
select client, view, tile, max(quality) as quality, arg_min(us, (-quality, us)) as arrived_us, count(*) filter (before is null or quality > before) as steps from shown group by client, view, tile""",
}
