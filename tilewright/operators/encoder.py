"""From images to container files: pyramid tiles, vector paths, whole files; and back to pixels.

An image is one row (id, width, height, rgba). Its tiles and walks are made where it lies; tiles, paths and files
are tables, so everything after that is joins and groups.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import codecs
from ..sources import container as S
from . import contours, paths, vision

TILES = "file_id long, level long, x long, y long, width int, height int, rgba binary"


def rgba_images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for key, width, height, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            data = data.as_py()
            if data is not None and width and height and len(data) == 4 * width * height:
                yield key, np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)


def chosen(images: DataFrame) -> DataFrame:
    return images.select(F.col("id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "rgba")


def pyramid(images: DataFrame, tile_size: int, max_zoom: int) -> DataFrame:
    """``TILES``: every level from 0 (whole size) to ``max_zoom`` (halved each time) in tiles; those without a visible pixel are left out.

    Images whose bytes are not width x height pixels have no tiles.
    """
    names = ["file_id", "level", "x", "y", "width", "height", "rgba"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, image in rgba_images(batches):
            rows = []
            for level in range(max_zoom + 1):
                width, height = image.shape[1] >> level, image.shape[0] >> level
                if not width or not height:
                    break
                small = image if not level else np.stack([vision.resized(image[:, :, c], width, height) for c in range(4)], axis=2)
                for y in range(0, height, tile_size):
                    for x in range(0, width, tile_size):
                        part = small[y : y + tile_size, x : x + tile_size]
                        if part[:, :, 3].any():
                            rows.append((key, level, x // tile_size, y // tile_size, part.shape[1], part.shape[0], part.tobytes()))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return chosen(images).mapInArrow(cut, TILES)


def grey(images: DataFrame) -> DataFrame:
    """The same images with one byte a pixel, by the usual weights of the colours."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((key, im.shape[1], im.shape[0], np.rint(im[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8).tobytes()) for key, im in rgba_images(batches))
        return vision.batches(made, vision.IMAGE_SCHEMA, 64)

    return chosen(images).mapInArrow(turn, vision.IMAGE)


def traced(images: DataFrame, low: float = 50, high: float = 100, least_points: int = 3) -> DataFrame:
    """``container.VECTORS``: one layer per image with a path for each walk over its edges; images without edges have none."""
    points = vision.contour_walks(vision.canny(grey(images), low, high), least_points=least_points)
    # Walks are numbered within an image; a path is one over all images.
    numbered = points.select(F.struct("id", "contour_id").alias("contour_id"), "seq", "x", "y")
    commands = contours.path_commands(numbered)
    white = F.array(*(F.lit(1.0) for _ in range(4)))
    return commands.select(
        F.col("path_id.id").alias("file_id"), F.lit(0).cast("long").alias("layer_id"), F.lit("edges").alias("name"), F.lit(1.0).alias("opacity"), F.lit("normal").alias("blend_mode"),
        F.col("path_id.contour_id").alias("path_id"), white.alias("fill"), "seq", "kind", "x", "y",
    )


def encode(images: DataFrame, tile_size: int = 512, max_zoom: int = 5, low: float = 50, high: float = 100, quality: int | None = None) -> DataFrame:
    """file_id, content: a container file for every image, with its pyramid and the paths over its edges; tiles are PNG, or JPEG of a quality."""
    meta = chosen(images).where("width > 0 and height > 0").select(F.col("id").alias("file_id"), F.col("width").cast("long"), F.col("height").cast("long"), F.lit(tile_size).cast("long").alias("tile_size"), F.lit(max_zoom).alias("max_zoom_level"))
    return S.write_files(S.encode_tiles(pyramid(images, tile_size, max_zoom), quality), meta, traced(images, low, high), quality)


def wanted_tiles(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Sound payloads of the tiles that the regions (file_id, level, rx, ry, rw, rh, in pixels of the level) touch, beside them."""
    parts = S.sections(files)
    held = S.payloads(parts).where("sound").select("file_id", "level", "x", "y", "payload")
    return wanted_cells(parts, regions).join(held, ["file_id", "level", "x", "y"])


def wanted_cells(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """The regions with tile_size and the places x, y of every tile of theirs."""
    sizes = S.parse_metadata(parts).where("error is null").select("file_id", "tile_size")
    asked = regions.join(sizes, "file_id").where("rw > 0 and rh > 0")
    first, last = lambda at: F.expr(f"{at} div tile_size"), lambda at, n: F.expr(f"({at} + {n} - 1) div tile_size")
    return asked.withColumn("x", F.explode(F.sequence(first("rx"), last("rx", "rw")))).withColumn("y", F.explode(F.sequence(first("ry"), last("ry", "rh"))))


def found_tiles(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """file_id, level, x, y, tile_size, rise, hx, hy, payload: for every tile that regions touch the sound one at its place (rise 0), or at the nearest coarser level.

    ``rise`` is how many levels up that is, ``hx, hy`` its place there: a pixel of the region is the one at its coordinates shifted by
    so many bits. Where no level has a tile there is no row.
    """
    cells = wanted_cells(parts, regions).select("file_id", "level", "x", "y", "tile_size").distinct()
    tops = S.parse_metadata(parts).where("error is null").select("file_id", F.col("max_zoom_level").cast("long").alias("most"))
    up = cells.join(tops, "file_id").withColumn("rise", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("most") - F.col("level"), F.lit(0)))))
    up = up.select("file_id", "level", "x", "y", "tile_size", "rise", (F.col("level") + F.col("rise")).alias("held"), *(F.expr(f"shiftright({c}, cast(rise as int))").alias(f"h{c}") for c in "xy"))
    tiles = S.payloads(parts).where("sound").select("file_id", F.col("level").alias("held"), F.col("x").alias("hx"), F.col("y").alias("hy"), "payload")
    nearest = up.join(tiles, ["file_id", "held", "hx", "hy"]).groupBy("file_id", "level", "x", "y", "tile_size").agg(F.min_by(F.struct("rise", "hx", "hy", "payload"), "rise").alias("n"))
    return nearest.select("file_id", "level", "x", "y", "tile_size", "n.*")


PIXELS = "file_id long, level long, x long, y long, r int, g int, b int, a int"


def cell_pixels(found: DataFrame) -> DataFrame:
    """``PIXELS`` of the places of :func:`found_tiles`, each where it is decoded. Payloads that are no image give none."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, level, x, y, side, rise, hx, hy, payload in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    image = codecs.from_png(payload)
                except (ValueError, zlib.error, struct.error):
                    continue
                sx, sy = ((np.arange(k * side, k * side + side) >> rise) - h * side for k, h in ((x, hx), (y, hy)))
                ax, ay = np.nonzero(sx < image.shape[1])[0], np.nonzero(sy < image.shape[0])[0]
                part = image[sy[ay]][:, sx[ax]].reshape(-1, 4).astype(np.int32)
                px, py = np.meshgrid(ax + x * side, ay + y * side)
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int64)) for v in (file_id, level)] + [pa.array(v.ravel().astype(np.int64)) for v in (px, py)] + [pa.array(part[:, c]) for c in range(4)], ["file_id", "level", "x", "y", *"rgba"])

    keys = [F.col(c).cast("long").alias(c) for c in ("file_id", "level", "x", "y", "tile_size", "rise", "hx", "hy")]
    return found.select(*keys, "payload").mapInArrow(spread, PIXELS)


def render(files: DataFrame, regions: DataFrame) -> DataFrame:
    """``PIXELS`` of regions (file_id, level, rx, ry, rw, rh, in pixels of the level) with the vector layers drawn over them.

    A tile that a level lacks is taken from the nearest coarser level that has it, each of its pixels for several; what no
    level holds is transparent. Layers are drawn in the order of their ids, each path over what is below it
    with the layer's opacity, at the scale of the level; a pixel is in a path if its centre is, by the even-odd rule, and in a stroke
    if its centre is near enough to a line (:mod:`paths`).
    """
    parts = S.sections(files)
    held = cell_pixels(found_tiles(parts, regions))
    asked = regions.where("rw > 0 and rh > 0").withColumn("x", F.explode(F.sequence("rx", F.col("rx") + F.col("rw") - 1))).withColumn("y", F.explode(F.sequence("ry", F.col("ry") + F.col("rh") - 1)))
    pixels = asked.select("file_id", "level", "x", "y").distinct().join(held, ["file_id", "level", "x", "y"], "left").select("file_id", "level", "x", "y", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"))
    shown = S.parse_paths(parts).join(regions.select("file_id", "level").distinct(), "file_id")
    extents = regions.where("rw > 0 and rh > 0").groupBy("file_id", "level").agg(F.min("rx").alias("lowx"), F.max(F.col("rx") + F.col("rw") - 1).alias("highx"), F.min("ry").alias("lowy"), F.max(F.col("ry") + F.col("rh") - 1).alias("highy"))
    return paths.drawn(pixels, paths.scaled(shown, F.pow(F.lit(2.0), -F.col("level"))), ["file_id", "level"], extents)


def prefetched(viewports: DataFrame, cached: DataFrame, loading: DataFrame, tile: int, most: int) -> DataFrame:
    """client, x, y, place: the first ``most`` tiles around where each client will look that it neither has nor loads, nearest first.

    ``viewports`` are rows of one place in time per client (client, ahead: the predicted x); ``cached`` and
    ``loading`` are (client, x, y).
    """
    from .tiles import rings

    centre = viewports.select("client", F.floor(F.col("ahead") / tile).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")).distinct()
    near = rings(centre, 2).groupBy("client", "x", "y").agg(F.min("radius").alias("radius"))
    missing = near.join(cached, ["client", "x", "y"], "left_anti").join(loading, ["client", "x", "y"], "left_anti")
    order = Window.partitionBy("client").orderBy("radius", "y", "x")
    return missing.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("client", "x", "y", "place")
