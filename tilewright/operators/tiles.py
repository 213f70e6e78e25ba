"""Tile pyramids as relations: coordinates, grids, lookups, validation, counts and offsets.

Grids are generated with ``sequence`` and meet an index in equi joins; no index is scanned by Python. Sizes are
those of level 0; a level halves both sides. ``mode`` says whether half pixels count (ceil) or not (floor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["level", "x", "y"]
MAX_SIDE, MAX_ZOOM, TILE_VERSION = 65536, 20, 1
#: Files whose metadata a task holds at once when index entries meet it.
FILES_AT_ONCE = 1 << 14


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def scale(level: Column) -> Column:
    """Level-0 pixels on a side of one pixel of a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))


def pixel_to_tile(pixel: Column, level: Column, tile: Column | int) -> Column:
    """Index of the tile of a level that holds a level-0 coordinate."""
    return div(div(pixel.cast("long"), scale(level)), tile)


def tile_bounds(x: Column, y: Column, level: Column, tile: Column | int) -> list[Column]:
    """Level-0 box of a tile (px, py, pw, ph), not clipped to the image."""
    side = (scale(level) * tile).cast("long")
    return [(x * side).alias("px"), (y * side).alias("py"), side.alias("pw"), side.alias("ph")]


def across(size: Column, level: Column, tile: Column | int, mode: str = "ceil") -> Column:
    """Tiles along a side of a level."""
    if mode == "floor":
        return div(div(size, scale(level)) + tile - 1, tile)
    side = scale(level) * tile
    return div(size + side - 1, side)


def levels(meta: DataFrame) -> DataFrame:
    """One row for each level 0 to max_zoom_level of each file."""
    return meta.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("max_zoom_level").cast("int"))))


def tile_count(meta: DataFrame, mode: str = "ceil") -> DataFrame:
    """file_id, tiles: how many tiles the levels of a file have."""
    tiles = across(F.col("width"), F.col("level"), F.col("tile_size"), mode) * across(F.col("height"), F.col("level"), F.col("tile_size"), mode)
    return levels(meta).groupBy("file_id").agg(F.sum(tiles).cast("long").alias("tiles"))


def grid(meta: DataFrame, mode: str = "floor") -> DataFrame:
    """file_id, level, x, y: all tiles of all levels. A level without pixels has none."""
    columns = across(F.col("width"), F.col("level"), F.col("tile_size"), mode)
    rows = across(F.col("height"), F.col("level"), F.col("tile_size"), mode)
    sized = levels(meta).withColumns({"nx": columns, "ny": rows}).where((F.col("nx") > 0) & (F.col("ny") > 0))
    sized = sized.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    return sized.select("file_id", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("x"), "y")


def tile_size_on_level(meta_grid: DataFrame) -> DataFrame:
    """Adds the pixels of each tile that lie in the image: tw, th (rows with width, height, tile_size, level, x, y)."""
    def inside(size: str, at: str) -> Column:
        return F.least(F.col("tile_size"), div(F.col(size), scale(F.col("level"))) - F.col(at) * F.col("tile_size"))

    return meta_grid.withColumns({"tw": inside("width", "x"), "th": inside("height", "y")})


def regions(meta: DataFrame, side: int) -> DataFrame:
    """file_id, x, y, w, h: a regular grid of level-0 regions, clipped at the edges."""
    step = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(side).cast("long")))
    cells = meta.where("width > 0 and height > 0").withColumn("y", step("height")).withColumn("x", step("width"))
    return cells.select("file_id", "x", "y", F.least(F.lit(side), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(side), F.col("height") - F.col("y")).alias("h"))


def candidates(rects: DataFrame, tile: int) -> DataFrame:
    """Adds x, y: the tiles of ``level`` that a rectangle (rx, ry, rw, rh: level-0 pixels) touches. Empty ones touch none."""
    full = rects.where("rw > 0 and rh > 0")
    run = lambda at, size: F.explode(F.sequence(pixel_to_tile(F.col(at), F.col("level"), tile), pixel_to_tile(F.col(at) + F.col(size) - 1, F.col("level"), tile)))
    return full.withColumn("y", run("ry", "rh")).withColumn("x", run("rx", "rw"))


def intersecting(rects: DataFrame, index: DataFrame, tile: int) -> DataFrame:
    """The tiles of ``index`` that the rectangles touch, one row for each rectangle and tile."""
    return candidates(rects, tile).join(index.select(*KEY), KEY, "left_semi")


def with_offsets(index: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds offset: the bytes before each tile in the order level, y, x, in each file (``by``)."""
    order = Window.partitionBy(*by).orderBy("level", "y", "x").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))


def bucketed_offsets(index: DataFrame, by: list[str] = ()) -> DataFrame:
    """As :func:`with_offsets` for very large files: sums of rows of tiles first, then within a row.

    A file has at most some hundred rows of tiles a level, as its sides are bounded.
    """
    turn = [*by, "level", "y"]
    row_sums = index.groupBy(*turn).agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy(*by).orderBy("level", "y").rowsBetween(Window.unboundedPreceding, -1)
    starts = row_sums.select(*turn, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*turn).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    local = index.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(starts, turn).withColumn("offset", (F.col("base") + F.col("local")).cast("long")).drop("base", "local")


def metadata_violation() -> Column:
    """The first rule that a metadata row breaks, or null."""
    size = F.col("tile_size")
    return (
        F.when(F.col("version") > TILE_VERSION, "version")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "zero_dimension")
        .when((F.col("width") > MAX_SIDE) | (F.col("height") > MAX_SIDE), "dimension_too_large")
        .when((size <= 0) | (size.bitwiseAND(size - 1) != 0), "tile_size_not_power_of_two")
        .when(F.col("max_zoom_level") > MAX_ZOOM, "zoom_too_high")
    )


def by_file(meta: DataFrame) -> DataFrame:
    """``meta`` dealt by its files, few enough a part to be held in memory. Rows that are made of a file's row stay in its part."""
    parts = max(meta.sparkSession.sparkContext.defaultParallelism, -(-meta.count() // FILES_AT_ONCE))
    return meta.repartition(parts, "file_id")


def index_violations(index: DataFrame, meta: DataFrame) -> DataFrame:
    """file_id, level, x, y, code: every index entry outside its file's pyramid.

    Metadata is hashed part by part: a planner that can't tell how many entries a file has must not send the index to every task.
    """
    joined = index.join(by_file(meta).hint("shuffle_hash"), "file_id")
    beyond = lambda at, size: F.col(at) >= across(F.col(size), F.col("level"), F.col("tile_size"))
    code = F.when(F.col("level") > F.col("max_zoom_level"), "level").when(beyond("x", "width"), "x").when(beyond("y", "height"), "y")
    return joined.select("file_id", *KEY, code.alias("code")).where("code is not null")


def count_violations(index: DataFrame, meta: DataFrame) -> DataFrame:
    """file_id, tiles, held: files with more index entries than their pyramid has tiles."""
    held = index.groupBy("file_id").agg(F.count("*").alias("held"))
    return tile_count(meta).join(held, "file_id").where(F.col("held") > F.col("tiles")).select("file_id", "tiles", "held")


def rings(centres: DataFrame, radius: int = 9) -> DataFrame:
    """Adds radius, dx, dy, x, y: tiles around the centre tile (cx, cy) by Chebyshev distance, without negative ones."""
    step = lambda: F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    around = centres.withColumn("dx", step()).withColumn("dy", step())
    around = around.withColumns({"radius": F.greatest(F.abs("dx"), F.abs("dy")), "x": F.col("cx") + F.col("dx"), "y": F.col("cy") + F.col("dy")})
    return around.where("x >= 0 and y >= 0")


def placement(tiles: DataFrame, tile: int) -> DataFrame:
    """Adds src_x, src_y, dst_x, dst_y, cw, ch: which part of a tile goes where in a rectangle (rx, ry, rw, rh) of its level-0 pixels."""
    out = tiles
    for axis, at, size in (("x", "rx", "rw"), ("y", "ry", "rh")):
        side = scale(F.col("level")) * tile
        start = F.col(axis) * side
        src, dst = F.greatest(F.col(at) - start, F.lit(0)), F.greatest(start - F.col(at), F.lit(0))
        out = out.withColumns({f"src_{axis}": src.cast("long"), f"dst_{axis}": dst.cast("long"), f"c{'w' if axis == 'x' else 'h'}": F.least(side - src, F.col(size) - dst).cast("long")})
    return out


def latest(entries: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: of the rows of a key the one with the largest ``order``."""
    return entries.groupBy(*key).agg(F.max_by(F.struct(*[c for c in entries.columns if c not in key]), order).alias("s")).select(*key, "s.*")


def best_quality(tiles: DataFrame) -> DataFrame:
    """The held version of each tile with the highest quality."""
    return latest(tiles, KEY, "quality")


def level_counts(index: DataFrame) -> DataFrame:
    """level, tiles, bytes, and a last row (level null) for all levels."""
    return index.rollup("level").agg(F.count("*").alias("tiles"), F.sum("size").cast("long").alias("bytes"))


def parse_spec(spec: Column) -> list[Column]:
    """level, x, y of a text like ``3/10_20``; nulls where it is not of this form."""
    return [F.regexp_extract(spec, r"^(\d{1,9})/(\d{1,9})_(\d{1,9})$", k).try_cast("int").alias(n) for k, n in ((1, "level"), (2, "x"), (3, "y"))]
