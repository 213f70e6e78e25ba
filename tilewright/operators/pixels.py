"""Pixels as rows (image columns, x, y, channels): features of regions, masks, filters, compositing.

Images are keyed by ``by``; windows and groups never span images. Channels are 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import with_checkpoints
from . import tiled
from .tiles import div

# Weights of red, green and blue in brightness.
LUMA = (0.299, 0.587, 0.114)


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return LUMA[0] * F.col(r) + LUMA[1] * F.col(g) + LUMA[2] * F.col(b)


def clamp(value: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def smoothstep(value: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, a smooth rise between them."""
    t = clamp((value - low) / float(high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def not_empty(pixels: DataFrame, by: list[str]) -> DataFrame:
    """The images with a pixel that is not fully transparent."""
    return pixels.groupBy(*by).agg(F.bool_and(F.col("a") == 0).alias("empty")).where(~F.col("empty")).select(*by)


def block_density(marked: DataFrame, by: list[str], side: int = 64) -> DataFrame:
    """by, bx, by_, density: the share of marked pixels (column ``edge``) in each block; edge blocks are smaller."""
    blocks = marked.groupBy(*by, div(F.col("x"), side).alias("bx"), div(F.col("y"), side).alias("by_"))
    return blocks.agg((F.count_if("edge") / F.count("*")).alias("density"))


def block_type(blocks: DataFrame, threshold: float = 0.1) -> DataFrame:
    return blocks.withColumn("region_type", F.when(F.col("density") > threshold, "vector").otherwise("raster"))


def texture(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, texture: population deviation of brightness (column ``g``) over 255, from whole sums."""
    n, s, q = F.count("*"), F.sum(F.col("g").cast("long")), F.sum(F.col("g").cast("long") * F.col("g"))
    return pixels.groupBy(*by).agg((F.sqrt((n * q - s * s).cast("double")) / n / 255).alias("texture"))


def colour_variance(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, variance: the root of the mean variance of red, green and blue, over 255."""
    parts = []
    for c in "rgb":
        n, s, q = F.count("*"), F.sum(F.col(c).cast("long")), F.sum(F.col(c).cast("long") * F.col(c))
        parts.append((n * q - s * s).cast("double") / (n * n))
    return pixels.groupBy(*by).agg((F.sqrt((parts[0] + parts[1] + parts[2]) / 3) / 255).alias("variance"))


def with_neighbours(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds left, right, up, down: the values of the four neighbours, null outside the image."""
    row, column = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")
    return pixels.withColumns({"left": F.lag(value).over(row), "right": F.lead(value).over(row), "up": F.lag(value).over(column), "down": F.lead(value).over(column)})


def noise(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, noise: the mean absolute four-neighbour Laplacian of inner pixels over 255. Images without inner pixels have no row."""
    near = with_neighbours(pixels, by, "g").where("left is not null and right is not null and up is not null and down is not null")
    return near.groupBy(*by).agg((F.sum(F.abs(4 * F.col("g") - F.col("left") - F.col("right") - F.col("up") - F.col("down")).cast("long")) / F.count("*") / 255).alias("noise"))


def mask(pixels: DataFrame, confidence: Column, threshold: float = 0.7) -> DataFrame:
    return pixels.withColumn("inside", confidence > threshold)


def mask_measures(masked: DataFrame, by: list[str]) -> DataFrame:
    """by, area, total, x, y, w, h (inclusive; null for empty masks), edge_density, complexity.

    Edge density: the share of inner mask pixels with an unset neighbour.
    """
    near = with_neighbours(masked, by, "inside")
    inner = F.col("inside") & F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("up").isNotNull() & F.col("down").isNotNull()
    edge = inner & ~(F.col("left") & F.col("right") & F.col("up") & F.col("down"))
    set_x, set_y = F.when(F.col("inside"), F.col("x")), F.when(F.col("inside"), F.col("y"))
    out = near.groupBy(*by).agg(
        F.count_if("inside").alias("area"), F.count("*").alias("total"), F.min(set_x).alias("x"), F.min(set_y).alias("y"),
        (F.max(set_x) - F.min(set_x) + 1).alias("w"), (F.max(set_y) - F.min(set_y) + 1).alias("h"),
        F.coalesce(F.try_divide(F.count_if(edge), F.count_if(inner)), F.lit(0.0)).alias("edge_density"),
    )
    return out.withColumn("complexity", F.col("edge_density") * (1 - F.col("area") / F.col("total")))


def mask_type(measured: DataFrame, complexity: float = 0.5) -> DataFrame:
    return measured.withColumn("region_type", F.when(F.col("complexity") < complexity, "vector").otherwise("raster"))


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.groupBy(*by, "r", "g", "b", "a").agg(F.count("*").alias("n"))


def dominant_colours(pixels: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """by, place, r, g, b, a, n: the most frequent colours, ties to the smaller colour."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "r", "g", "b", "a")
    return histogram(pixels, by).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def inside_regions(pixels: DataFrame, regions: DataFrame, by: list[str], side: int = 4) -> DataFrame:
    """The pixels that lie in a region (by, x, y, w, h) of their image. They meet on blocks of ``side`` pixels."""
    step = lambda at, size: F.explode(F.sequence(div(F.col(at), side), div(F.col(at) + F.col(size) - 1, side)))
    r = regions.where("w > 0 and h > 0").withColumn("bx", step("x", "w")).withColumn("by_", step("y", "h")).alias("r")
    p = pixels.alias("p")
    same = (div(F.col("p.x"), side) == F.col("r.bx")) & (div(F.col("p.y"), side) == F.col("r.by_"))
    for c in by:
        same = same & (F.col(f"p.{c}") == F.col(f"r.{c}"))
    within = (F.col("p.x") >= F.col("r.x")) & (F.col("p.x") < F.col("r.x") + F.col("r.w")) & (F.col("p.y") >= F.col("r.y")) & (F.col("p.y") < F.col("r.y") + F.col("r.h"))
    return p.join(r, same & within, "left_semi")


def blend(over: str, under: str, alpha: float) -> list[Column]:
    """Channels of one pixel over another with a global alpha, cut to whole numbers; alphas add up."""
    sa = F.col(f"{over}.a") / 255 * alpha
    parts = [F.floor(F.col(f"{over}.{c}") * sa + F.col(f"{under}.{c}") * (1 - sa)).cast("int").alias(c) for c in "rgb"]
    return [*parts, F.floor(F.least(F.col(f"{over}.a") * alpha + F.col(f"{under}.a") * (1 - alpha), F.lit(255.0))).cast("int").alias("a")]


def mix_channel(mode: str, source: Column, target: Column) -> Column:
    """Blend modes over channels from 0 to 1. Unknown modes give the source."""
    return {
        "multiply": source * target,
        "screen": 1 - (1 - source) * (1 - target),
        "overlay": F.when(target < 0.5, 2 * source * target).otherwise(1 - 2 * (1 - source) * (1 - target)),
    }.get(mode, source)


def composite(target: DataFrame, layer: DataFrame, by: list[str], opacity: float = 1.0, mode: str = "normal") -> DataFrame:
    """``layer`` over ``target`` pixel by pixel; where the layer has no pixel the target stays. The larger alpha wins."""
    t, s = target.alias("t"), layer.alias("s")
    on = (F.col("t.x") == F.col("s.x")) & (F.col("t.y") == F.col("s.y"))
    for c in by:
        on = on & (F.col(f"t.{c}") == F.col(f"s.{c}"))
    share = F.col("s.a") / 255 * opacity
    out = [F.col(f"t.{c}") for c in (*by, "x", "y")]
    for c in "rgb":
        mixed = mix_channel(mode, F.col(f"s.{c}") / 255, F.col(f"t.{c}") / 255) * 255
        out.append(F.when(F.col("s.a").isNull() | (F.col("s.a") == 0), F.col(f"t.{c}")).otherwise(F.floor(mixed * share + F.col(f"t.{c}") * (1 - share) + 1e-9)).cast("int").alias(c))
    return t.join(s, on, "left").select(*out, F.greatest(F.col("t.a"), F.coalesce("s.a", F.lit(0))).cast("int").alias("a"))


def to_lab(pixels: DataFrame) -> DataFrame:
    """Adds l, la, lb: an approximate Lab colour with a square for the gamma and no cube root."""
    r, g, b = (F.col(c) / 255 * (F.col(c) / 255) for c in "rgb")
    # Linear RGB to XYZ.
    x = 0.4124564 * r + 0.3575761 * g + 0.1804375 * b
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = 0.0193339 * r + 0.1191920 * g + 0.9503041 * b
    return pixels.withColumns({"l": 116 * y - 16, "la": 500 * (x - y), "lb": 200 * (y - z)})


def kernel_size(sigma: float) -> int:
    return max(int(6 * sigma), 3) | 1


def gaussian_kernel(frame: DataFrame, sigma: float) -> DataFrame:
    """k (offset from the middle), weight: weights that add up to 1. ``frame`` only gives the session."""
    return gaussian_kernels(frame.sparkSession.range(1).select("id", F.lit(float(sigma)).alias("sigma")), ["id"]).select("k", "weight")


def gaussian_kernels(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, k (offset from the middle), weight: weights that add up to 1 for each row's ``sigma``."""
    half = div(F.greatest((F.col("sigma") * 6).cast("int"), F.lit(3)).bitwiseOR(F.lit(1)), 2).cast("int")  # of kernel_size
    raw = rows.withColumn("k", F.explode(F.sequence(-half, half))).select(*by, "k", F.exp(-F.col("k") * F.col("k") / (2.0 * F.col("sigma") * F.col("sigma"))).alias("raw"))
    return raw.select(*by, "k", (F.col("raw") / F.sum("raw").over(Window.partitionBy(*by))).alias("weight"))


def blur(pixels: DataFrame, by: list[str], weights: list[int]) -> DataFrame:
    """Separable blur of ``g`` with whole weights and clamped edges, cut to whole numbers after each pass.

    A clamped edge is no window frame: every pixel asks for the pixels at the clamped places in its row (column).
    """
    half, total = len(weights) // 2, sum(weights)
    taps = F.explode(F.array(*(F.struct(F.lit(k - half).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)))).alias("tap")
    out = pixels
    for axis, other in (("x", "y"), ("y", "x")):
        size = Window.partitionBy(*by, other)
        asked = out.withColumn("last", F.max(axis).over(size)).select(*by, "x", "y", "last", taps)
        asked = asked.select(*by, "x", "y", F.col("tap.w").alias("w"), F.least(F.greatest(F.col(axis) + F.col("tap.k"), F.lit(0)), F.col("last")).alias("at"))
        held = out.select(*by, F.col(axis).alias("at"), F.col(other).alias("same"), "g")
        met = asked.withColumn("same", F.col(other)).join(held, [*by, "at", "same"])
        out = met.groupBy(*by, "x", "y").agg(div(F.sum(F.col("w") * F.col("g")).cast("long"), total).cast("int").alias("g"))
    return out


def brightness(pixels: DataFrame, change: int) -> DataFrame:
    return pixels.withColumns({c: clamp(F.col(c) + change).cast("int") for c in "rgb"})


def preview_size(width: Column, height: Column, most: int = 256) -> list[Column]:
    """Sides of the largest image of the same shape within ``most`` pixels; small ones stay."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return [F.greatest(F.floor(width * ratio), F.lit(1)).cast("int").alias("pw"), F.greatest(F.floor(height * ratio), F.lit(1)).cast("int").alias("ph")]


def box_mean(pixels: DataFrame, by: list[str], level: int) -> DataFrame:
    """One level of a pyramid by block means, cut to whole numbers."""
    side = 1 << level
    blocks = pixels.groupBy(*by, div(F.col("x"), side).cast("int").alias("x"), div(F.col("y"), side).cast("int").alias("y"))
    return blocks.agg(div(F.sum(F.col("g").cast("long")), F.count("*")).cast("int").alias("g"))


def enlarge(rect: DataFrame, small: DataFrame, by: list[str], level: int) -> DataFrame:
    """Pixels of ``rect`` (by, x, y) from a smaller level by the nearest one; 0 where there is none."""
    side = 1 << level
    asked = rect.withColumns({"sx": div(F.col("x"), side).cast("int"), "sy": div(F.col("y"), side).cast("int")})
    held = small.select(*by, F.col("x").alias("sx"), F.col("y").alias("sy"), "g")
    return asked.join(held, [*by, "sx", "sy"], "left").select(*by, "x", "y", F.coalesce("g", F.lit(0)).alias("g"))


def fill_boxes(pixels: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, n: how many boxes (by, bx, by_, w, h) paint each pixel."""
    met = pixels.join(boxes, by).where((F.col("x") >= F.col("bx")) & (F.col("x") < F.col("bx") + F.col("w")) & (F.col("y") >= F.col("by_")) & (F.col("y") < F.col("by_") + F.col("h")))
    return met.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def centre_colour(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, r, g, b, a from 0 to 1: the colour in the middle of each image."""
    size = Window.partitionBy(*by)
    middle = pixels.withColumns({"cx": div(F.max("x").over(size) + 1, 2), "cy": div(F.max("y").over(size) + 1, 2)})
    return middle.where("x = cx and y = cy").select(*by, *((F.col(c) / 255.0).alias(c) for c in "rgba"))


def labels8(pixels: DataFrame, by: list[str], threshold: int = 128, side: int = tiled.SIDE) -> DataFrame:
    """by, x, y, label: 8-connected components of the pixels above ``threshold``, labelled by their smallest place (65536 times the row, plus the column).

    Components are found inside tiles of ``side`` pixels, and followed across their borders as a graph (:func:`tiled.labels`).
    An image is not gathered anywhere.
    """
    found = tiled.labels(pixels.where(F.col("g") > threshold), by, side)
    place = div(F.col("label"), tiled.ROW) * 65536 + F.col("label") % tiled.ROW
    return found.select(*by, F.col("x").cast("int"), F.col("y").cast("int"), place.alias("label"))


def smallest_linked(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, a, label: for every node of ``edges`` (by, a, b) the smallest node that it is linked with, within each ``by``.

    Every node hangs its larger neighbours, then its smaller ones, on the smallest of them, until nothing changes.
    """
    with_checkpoints(edges.sparkSession)

    def hang(e: DataFrame, larger: bool) -> DataFrame:
        high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        both = e.select(*by, high, low)
        if larger:
            both = both.unionByName(e.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        least = both.groupBy(*by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = both.join(least, [*by, "a"])
        out = met.where("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b")) if larger else met.select(*by, F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first()
    now = edges.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = state(now)
    while before[0]:
        now = hang(hang(now, True), False).checkpoint()
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(*by, "a", F.col("b").alias("label"))
