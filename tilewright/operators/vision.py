"""Sequential image operators on image rows (id, width, height, data: one byte a pixel).

An image is one row and is handled where it lies: no shuffle, no exploded pixels. Rows whose data does not have
width x height bytes give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "id long, width int, height int, data binary"


def images(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in rows:
        for key, width, height, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if data is not None and width and height and len(data) == width * height:
                yield key, np.frombuffer(data, dtype=np.uint8).reshape(height, width)


def chosen(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "data")


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch_of(held, schema)
            held = []
    yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


IMAGE_SCHEMA = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
POINT_SCHEMA = pa.schema([("id", pa.int64()), ("contour_id", pa.int64()), ("seq", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])


def convolved(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """One pass of a separable filter; the border pixels go on outside."""
    half = len(weights) // 2
    wide = np.pad(image, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
    size = image.shape[axis]
    return sum(w * np.take(wide, range(k, k + size), axis=axis) for k, w in enumerate(weights))


#: The blur of :func:`thinned`, and how far away a pixel can have a say: blur, gradient and thinning together.
SIGMA = 1.4
REACH = int(np.ceil(2 * SIGMA)) + 2


def thinned(image: np.ndarray, low: float, high: float, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """(strong, weak) edges of Canny's method: blur, gradient, thinning along it, thresholds; strong ones are weak too."""
    half = int(np.ceil(2 * sigma))
    bell = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    bell /= bell.sum()
    smooth = convolved(convolved(image.astype(float), bell, 0), bell, 1)
    slope, mean = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    gx, gy = convolved(convolved(smooth, slope, 1), mean, 0), convolved(convolved(smooth, slope, 0), mean, 1)
    size = np.hypot(gx, gy)
    ring = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: ring[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros_like(size, dtype=bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (sector == k) & (size > at(-dy, -dx)) & (size >= at(dy, dx))
    return thin & (size >= high), thin & (size >= low)


def edges_of(image: np.ndarray, low: float, high: float, sigma: float = SIGMA) -> np.ndarray:
    """Canny edges: strong ones, and weak ones only where they touch strong ones."""
    strong, weak = thinned(image, low, high, sigma)
    h, w = image.shape
    while True:
        wide = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                near |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        grown = near & weak
        if (grown == strong).all():
            return strong
        strong = grown


def canny(df: DataFrame, low: float = 50, high: float = 100) -> DataFrame:
    """Image rows with 255 at edges and 0 elsewhere."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((key, im.shape[1], im.shape[0], (edges_of(im, low, high) * np.uint8(255)).tobytes()) for key, im in images(rows))
        return batches(made, IMAGE_SCHEMA)

    return chosen(df).mapInArrow(run, IMAGE)


def walks(marked: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Greedy walks over the marked pixels: from each one that is left, in rows, to the first free neighbour, columns first."""
    free = {(int(x), int(y)) for y, x in zip(*np.nonzero(marked))}
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    for start in sorted(free, key=lambda p: (p[1], p[0])):
        if start not in free:
            continue
        path, now = [], start
        while now is not None:
            free.discard(now)
            path.append(now)
            now = next((p for dx, dy in steps if (p := (now[0] + dx, now[1] + dy)) in free), None)
        yield path


def contour_walks(df: DataFrame, threshold: int = 128, least_points: int = 3) -> DataFrame:
    """id, contour_id, seq, x, y: the walks of ``least_points`` and more over pixels above ``threshold``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            (key, number, seq, float(x), float(y))
            for key, im in images(rows)
            for number, path in enumerate(p for p in walks(im > threshold) if len(p) >= least_points)
            for seq, (x, y) in enumerate(path)
        )
        return batches(made, POINT_SCHEMA)

    return chosen(df).mapInArrow(run, "id long, contour_id long, seq int, x double, y double")


def lanczos_weights(size: int, new: int, lobes: int = 3) -> np.ndarray:
    """(new x size) weights; rows add up to 1. Shrinking widens the kernel."""
    step = size / new
    centre = (np.arange(new) + 0.5) * step - 0.5
    x = (np.arange(size)[None, :] - centre[:, None]) / max(step, 1.0)
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    out = lanczos_weights(image.shape[0], height) @ image.astype(float) @ lanczos_weights(image.shape[1], width).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def lanczos(df: DataFrame, level: int) -> DataFrame:
    """Image rows of a pyramid level: both sides halved ``level`` times; images without pixels there go."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            (key, w, h, resized(im, w, h).tobytes())
            for key, im in images(rows)
            for w, h in [(im.shape[1] >> level, im.shape[0] >> level)]
            if w and h
        )
        return batches(made, IMAGE_SCHEMA)

    return chosen(df).mapInArrow(run, IMAGE)
