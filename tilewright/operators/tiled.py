"""Operators on images of any size, as tables of tiles: nothing gathers an image.

A tile is a row (id, tx, ty, width, height, data: one byte a pixel) of up to ``side`` x ``side`` pixels; those of the last column
and row may be smaller. Tiles work side by side on what lies in them; what crosses their borders is exchanged as
strips (halos) or followed as a graph of border pixels only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import with_checkpoints
from . import vision
from .tiles import div

SIDE = 256
TILED = "id long, tx long, ty long, width int, height int, data binary"
TILED_NAMES = [c.split()[0] for c in TILED.split(", ")]
TILED_KINDS = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
#: A pixel as one number: its row times this, plus its column.
ROW = 1 << 31
#: Neighbours of a pixel that come after it in its row or in the next one.
AHEAD = ((1, 0), (-1, 1), (0, 1), (1, 1))


def roots(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat places of the marked pixels, the first place of each one's 8-connected component).

    Every pixel hangs on the smallest one that it touches, ways are halved, until all that touch agree: about the logarithm of the
    longest way in rounds of whole arrays.
    """
    height, width = mask.shape
    places = np.flatnonzero(mask)
    number = np.full(mask.size, -1, dtype=np.int64)
    number[places] = np.arange(len(places))
    number = number.reshape(mask.shape)
    ends = []
    for dx, dy in AHEAD:
        here = number[: height - dy, max(0, -dx) : width - max(0, dx)]
        there = number[dy:, max(0, dx) : width - max(0, -dx)]
        both = (here >= 0) & (there >= 0)
        ends.append(np.stack((here[both], there[both])))
    a, b = np.concatenate(ends, axis=1)
    parent = np.arange(len(places))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return places, places[parent]


def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return y.astype(np.int64) * ROW + x


def border_edges(border: DataFrame, by: list[str], side: int) -> DataFrame:
    """by, a, b: which components of tiles touch across a border. ``border``: by, x, y, root of the marked pixels at borders."""
    x, y = F.col("x"), F.col("y")
    ahead = F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in AHEAD))
    cell = lambda c: F.floor(c / side)
    steps = border.select(*by, x, y, F.col("root").alias("a"), F.explode(ahead).alias("to")).where((cell(x) != cell(F.col("to.x"))) | (cell(y) != cell(F.col("to.y"))))
    steps = steps.select(*by, "a", F.col("to.x").alias("x"), F.col("to.y").alias("y"))
    return steps.join(border.select(*by, "x", "y", F.col("root").alias("b")), [*by, "x", "y"]).select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def local_roots(pixels: DataFrame, by: list[str], side: int = SIDE) -> DataFrame:
    """by, x, y, root, border: marked pixels (by, x, y) with the first pixel (:func:`code`) of their component in their tile, and whether they lie at its border.

    A group is a tile of at most ``side`` x ``side`` pixels.
    """
    rows = pixels.select(*by, F.col("x").cast("long"), F.col("y").cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)

    def label(key: tuple, part: pa.Table) -> pa.Table:
        x, y = (part.column(c).to_numpy() for c in "xy")
        left, top = int(x[0]) // side * side, int(y[0]) // side * side
        mask = np.zeros((side, side), dtype=bool)
        mask[y - top, x - left] = True
        places, first = roots(mask)
        px, py = places % side, places // side
        out = {c: pa.array([k.as_py()] * len(places), part.schema.field(c).type) for c, k in zip(by, key)}
        out |= {"x": pa.array(px + left), "y": pa.array(py + top), "root": pa.array(code(first % side + left, first // side + top))}
        return pa.table(out | {"border": pa.array((px == 0) | (px == side - 1) | (py == 0) | (py == side - 1))})

    tile = [F.floor(F.col(c) / side).alias(f"t{c}") for c in "xy"]
    return rows.groupBy(*by, *tile).applyInArrow(label, f"{kinds}, x long, y long, root long, border boolean")


def labels(pixels: DataFrame, by: list[str], side: int = SIDE) -> DataFrame:
    """by, x, y, label: 8-connected components of marked pixels (by, x, y), labelled by their first pixel (:func:`code`).

    Components are found inside tiles first; only tiles' components that touch across borders are followed as a graph.
    """
    from .pixels import smallest_linked

    with_checkpoints(pixels.sparkSession)
    local = local_roots(pixels, by, side).checkpoint()
    linked = smallest_linked(border_edges(local.where("border").select(*by, "x", "y", "root"), by, side), by)
    return local.join(linked.withColumnRenamed("a", "root"), [*by, "root"], "left").select(*by, "x", "y", F.coalesce("label", "root").alias("label"))


def cut(images: DataFrame, side: int = SIDE) -> DataFrame:
    """``TILED`` of image rows (``vision.IMAGE``)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, image in vision.images(rows):
            made = [(key, x // side, y // side, image[y : y + side, x : x + side]) for y in range(0, image.shape[0], side) for x in range(0, image.shape[1], side)]
            yield tile_batch([(i, tx, ty, p.shape[1], p.shape[0], p.tobytes()) for i, tx, ty, p in made])

    return vision.chosen(images).mapInArrow(run, TILED)


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, TILED_KINDS)], TILED_NAMES)


def chosen(tiles: DataFrame) -> DataFrame:
    whole = F.length("data") == F.col("width") * F.col("height")
    return tiles.where(whole & (F.col("width") > 0)).select(*(F.col(c).cast("long").alias(c) for c in ("id", "tx", "ty")), F.col("width").cast("int"), F.col("height").cast("int"), "data")


def tiles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    for batch in batches:
        for key, tx, ty, width, height, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
            yield key, tx, ty, np.frombuffer(data, dtype=np.uint8).reshape(height, width)


def with_halos(tiles: DataFrame, reach: int) -> DataFrame:
    """``TILED`` and dx, dy: every tile, and the strips of its border that its eight neighbours need, at the neighbour's place.

    ``dx, dy`` say where a part comes from, seen from the tile that it is for.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tx, ty, image in tiles_in(batches):
            h, w = image.shape
            spans = lambda size: {0: slice(0, size), 1: slice(max(0, size - reach), size), -1: slice(0, min(reach, size))}
            rows = []
            for dy, ys in spans(h).items():
                for dx, xs in spans(w).items():
                    part = image[ys, xs]
                    rows.append((key, tx + dx, ty + dy, part.shape[1], part.shape[0], part.tobytes(), -dx, -dy))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [*TILED_KINDS, pa.int32(), pa.int32()])], [*TILED_NAMES, "dx", "dy"])

    return chosen(tiles).mapInArrow(send, TILED + ", dx int, dy int")


def joined_parts(part: pa.Table) -> tuple[np.ndarray, int, int, int, int] | None:
    """(the tile with the strips around it, its left and top place therein, its width and height) of the parts for one place; None where there is no tile."""
    parts = {(dx, dy): np.frombuffer(data, dtype=np.uint8).reshape(h, w) for dx, dy, w, h, data in zip(*(part.column(c).to_pylist() for c in ("dx", "dy", "width", "height", "data")))}
    if (0, 0) not in parts:
        return None
    h, w = parts[0, 0].shape
    sizes_x = {dx: max((p.shape[1] for (a, _), p in parts.items() if a == dx), default=0) for dx in (-1, 0, 1)}
    sizes_y = {dy: max((p.shape[0] for (_, b), p in parts.items() if b == dy), default=0) for dy in (-1, 0, 1)}
    sizes_x[0], sizes_y[0] = w, h
    whole = np.zeros((sum(sizes_y.values()), sum(sizes_x.values())), dtype=np.uint8)
    at_x, at_y = {-1: 0, 0: sizes_x[-1], 1: sizes_x[-1] + w}, {-1: 0, 0: sizes_y[-1], 1: sizes_y[-1] + h}
    for (dx, dy), p in parts.items():
        whole[at_y[dy] : at_y[dy] + p.shape[0], at_x[dx] : at_x[dx] + p.shape[1]] = p
    return whole, sizes_x[-1], sizes_y[-1], w, h


WEAK = "id long, tx long, ty long, width int, height int, places binary, roots binary, strong array<bigint>, border array<struct<x: bigint, y: bigint, root: bigint>>"


def canny(tiles: DataFrame, side: int = SIDE, low: float = 50, high: float = 100) -> DataFrame:
    """``TILED`` with 255 at edges and 0 elsewhere: those that :func:`vision.edges_of` finds in the whole image, pixel for pixel.

    Tiles thin their gradients with a halo of ``vision.REACH`` pixels of their neighbours. Weak edges stay if their component,
    followed across tiles by its border pixels, holds a strong one. ``side`` is at least the halo. Tiles of an image are all there;
    those whose data has not the bytes of its sides count as lacking, and what lacks is treated as outside of the image.
    """
    from .pixels import smallest_linked

    if side < vision.REACH or low > high:
        raise ValueError(f"tiles of {vision.REACH} pixels at least, and thresholds in order")

    def thin(key: tuple, part: pa.Table) -> pa.Table:
        found = joined_parts(part)
        rows = []
        if found is not None:
            whole, left, top, w, h = found
            strong, weak = (m[top : top + h, left : left + w] for m in vision.thinned(whole, low, high))
            places, first = roots(weak)
            i, tx, ty = (k.as_py() for k in key)
            px, py, fx, fy = places % w + tx * side, places // w + ty * side, first % w + tx * side, first // w + ty * side
            root = code(fx, fy)
            at = (places % w == 0) | (places % w == w - 1) | (places // w == 0) | (places // w == h - 1)
            border = [{"x": a, "y": b, "root": c} for a, b, c in zip(px[at].tolist(), py[at].tolist(), root[at].tolist())]
            rows.append((i, tx, ty, w, h, places.astype(np.int32).tobytes(), root.tobytes(), np.unique(root[strong.ravel()[places]]).tolist(), border))
        kinds = [*TILED_KINDS[:5], pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64()), ("root", pa.int64())]))]
        names = [c.split()[0] for c in ("id", "tx", "ty", "width", "height", "places", "roots", "strong", "border")]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, tx, ty, w, h, places, root, strong, linked in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.zeros(w * h, dtype=np.uint8)
                held = np.array(sorted({*strong, *(linked or [])}), dtype=np.int64)
                data[np.frombuffer(places, np.int32)[np.isin(np.frombuffer(root, np.int64), held)]] = 255
                rows.append((i, tx, ty, w, h, data.tobytes()))
            yield tile_batch(rows)

    with_checkpoints(tiles.sparkSession)
    weak = with_halos(tiles, vision.REACH).groupBy("id", "tx", "ty").applyInArrow(thin, WEAK).checkpoint()
    border = weak.select("id", F.inline("border"))
    others = smallest_linked(border_edges(border, ["id"], side), ["id"])
    linked = others.unionByName(others.select("id", F.col("label").alias("a"), "label").distinct())
    strong = weak.select("id", F.explode("strong").alias("a")).join(linked, ["id", "a"]).select("id", "label").distinct()
    # A component is in the tile that its first pixel lies in; so many of a tile touch its border.
    kept = linked.join(strong, ["id", "label"], "left_semi").select("id", *tile_of(F.col("a"), side), F.col("a").alias("root"))
    kept = kept.groupBy("id", "tx", "ty").agg(F.collect_list("root").alias("linked"))
    return weak.join(kept, ["id", "tx", "ty"], "left").select("id", "tx", "ty", "width", "height", "places", "roots", "strong", "linked").mapInArrow(keep, TILED)


def tile_of(root: Column, side: int) -> list[Column]:
    return [div(root % ROW, side).alias("tx"), div(div(root, ROW), side).alias("ty")]
