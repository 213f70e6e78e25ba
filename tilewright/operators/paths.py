"""Drawing paths with curves and strokes (``container.CURVES``): flattening, scan lines, coverage, painting.

A path is a list of commands by ``seq``; its subpaths begin at moves. Everything is joins, windows within a path and exploded rows:
the work is that of the rows that edges cross and of the pixels that are painted, never pixels times edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contours import segments

KEYS = ["file_id", "layer_id", "path_id"]
#: Pixels that a straight piece may stand for, and the most pieces of a curve.
TOLERANCE, MOST_PIECES = 0.25, 1 << 16
#: Columns that paths of lines may lack.
CURVE_COLUMNS = {"x1": "double", "y1": "double", "x2": "double", "y2": "double", "stroke": "array<double>", "stroke_width": "double"}


def with_curves(paths: DataFrame) -> DataFrame:
    """``paths`` with nulls for the columns of curves and strokes that it lacks."""
    return paths.withColumns({c: F.lit(None).cast(kind) for c, kind in CURVE_COLUMNS.items() if c not in paths.columns})


def scaled(paths: DataFrame, factor: Column) -> DataFrame:
    """Coordinates and widths times ``factor``."""
    return paths.withColumns({c: F.col(c) * factor for c in ("x", "y", "x1", "y1", "x2", "y2", "stroke_width")})


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def finite(*names: str) -> Column:
    """Whether all numbers of a row are finite."""
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def flattened(paths: DataFrame, tolerance: float = TOLERANCE, keys: list[str] = KEYS) -> DataFrame:
    """keys, sub, seq, k, x, y, closed: the corners of every subpath in order, curves cut in straight pieces.

    A curve has as many pieces as :func:`contours.segments` gives, between 8 (16 for cubic ones) and ``MOST_PIECES``. One without its control
    points is a line. Paths with a point that is no finite number have no corners. What follows a close goes on
    from the last point.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    points = with_curves(paths).where("path_id is not null").withColumns({
        "sub": F.count_if(F.col("kind") == "move").over(order), "sx": F.last("x", True).over(before), "sy": F.last("y", True).over(before),
        "sound": F.bool_and((F.col("kind") == "close") | finite("x", "y")).over(Window.partitionBy(*keys)),
    }).where("sound")
    points = points.withColumn("closed", F.bool_or(F.col("kind") == "close").over(Window.partitionBy(*keys, "sub")))
    x, y, x1, y1, x2, y2, sx, sy = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2", "sx", "sy"))
    quadratic, cubic = (F.col("kind") == "quadratic") & finite("x1", "y1", "sx", "sy"), (F.col("kind") == "cubic") & finite("x1", "y1", "x2", "y2", "sx", "sy")
    bow = distance(x1, y1, (sx + x) * 0.5, (sy + y) * 0.5)
    way = distance(sx, sy, x1, y1) + distance(x1, y1, x2, y2) + distance(x2, y2, x, y)
    pieces = F.when(quadratic | cubic, F.least(segments(bow, way, tolerance, F.col("kind")), F.lit(MOST_PIECES))).otherwise(1)
    rows = points.where("kind <> 'close'").withColumns({"quadratic": quadratic, "cubic": cubic, "pieces": pieces}).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "pieces")))
    t = F.col("k") / F.col("pieces").cast("double")
    u = 1.0 - t

    def at(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
        two = u * u * p0 + 2.0 * u * t * p1 + t * t * p3
        three = u * u * u * p0 + 3.0 * u * u * t * p1 + 3.0 * u * t * t * p2 + t * t * t * p3
        return F.when(F.col("quadratic"), two).when(F.col("cubic"), three).otherwise(p3)

    return rows.select(*keys, "sub", "seq", "k", at(sx, x1, x2, x).alias("x"), at(sy, y1, y2, y).alias("y"), "closed")


def outlines(corners: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, x, y, nx, ny, drawn: the edges of the subpaths; the one back to the start is drawn only if the subpath is closed."""
    order = Window.partitionBy(*keys, "sub").orderBy("seq", "k")
    start = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = corners.withColumns({**{f"next{c}": F.lead(c).over(order) for c in "xy"}, **{f"first{c}": F.first(c).over(start) for c in "xy"}})
    back = F.col("nextx").isNull()
    return rows.select(*keys, "x", "y", F.coalesce("nextx", "firstx").alias("nx"), F.coalesce("nexty", "firsty").alias("ny"), (~back | F.col("closed")).alias("drawn"))


def clipped(edges: DataFrame, extents: DataFrame, by: list[str], reach: Column) -> DataFrame:
    """``edges`` with py0 and py1, the first and last pixel rows within ``reach`` of them, and the columns lowx and highx of the pixels that are wanted."""
    first = F.ceil(F.least("y", "ny") - reach - 0.5)
    last = F.floor(F.greatest("y", "ny") + reach - 0.5)
    rows = edges.join(extents, by).withColumns({"py0": F.greatest(first, "lowy"), "py1": F.least(last, "highy")})
    return rows.where("py0 <= py1")


def filled(edges: DataFrame, extents: DataFrame, by: list[str], keys: list[str] = KEYS) -> DataFrame:
    """keys, x, y: the pixels whose centre is inside, by the even-odd rule over all subpaths.

    Edges say where they cross the centres of rows of pixels; between the first and the second crossing, the third and the
    fourth, and so on a row is inside. ``extents`` (by, lowx, highx, lowy, highy) are the pixels that are wanted.
    """
    rows = clipped(edges, extents, by, F.lit(0.0)).withColumn("row", F.explode(F.sequence("py0", "py1")))
    centre = F.col("row") + 0.5
    rows = rows.where((F.col("y") > centre) != (F.col("ny") > centre))
    at = (F.col("nx") - F.col("x")) * (centre - F.col("y")) / (F.col("ny") - F.col("y")) + F.col("x")
    lines = rows.select(*keys, "lowx", "highx", "row", at.alias("at")).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("at")).alias("ats"), F.first("lowx").alias("lowx"), F.first("highx").alias("highx"))
    spans = lines.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ats") - 1, F.lit(2))))
    left, right = F.ceil(F.element_at("ats", F.col("i")) - 0.5), F.ceil(F.element_at("ats", F.col("i") + 1) - 0.5) - 1
    spans = spans.select(*keys, "row", F.greatest(left, "lowx").alias("left"), F.least(right, "highx").alias("right")).where("left <= right")
    return spans.select(*keys, F.explode(F.sequence("left", "right")).alias("x"), F.col("row").alias("y"))


def to_segment(px: Column, py: Column) -> Column:
    """The squared distance of a point to the edge of the row."""
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.greatest(((px - F.col("x")) * dx + (py - F.col("y")) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (F.col("x") + t * dx), py - (F.col("y") + t * dy)
    return ex * ex + ey * ey


def stroked(edges: DataFrame, extents: DataFrame, by: list[str], keys: list[str] = KEYS) -> DataFrame:
    """keys, x, y: the pixels whose centre is within half of ``width`` of a drawn edge; joins and ends are round."""
    half = F.col("width") / 2.0
    rows = clipped(edges.where("drawn and width > 0"), extents, by, half).withColumn("row", F.explode(F.sequence("py0", "py1")))
    centre = F.col("row") + 0.5
    dy = F.col("ny") - F.col("y")
    # The part of the edge that is near enough in y says how far the row can be touched in x.
    at = lambda side: F.when(dy == 0, F.lit(0.0 if side < 0 else 1.0)).otherwise(F.least(F.greatest((centre + half * side * F.signum(dy) - F.col("y")) / dy, F.lit(0.0)), F.lit(1.0)))
    ends = [F.col("x") + at(side) * (F.col("nx") - F.col("x")) for side in (-1, 1)]
    rows = rows.withColumns({"left": F.greatest(F.ceil(F.least(*ends) - half - 0.5) - 1, "lowx"), "right": F.least(F.floor(F.greatest(*ends) + half - 0.5) + 1, "highx")}).where("left <= right")
    cells = rows.withColumn("px", F.explode(F.sequence("left", "right")))
    return cells.where(to_segment(F.col("px") + 0.5, centre) <= half * half).select(*keys, F.col("px").alias("x"), F.col("row").alias("y")).distinct()


def coverage(paths: DataFrame, extents: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """by, layer_id, path_id, part, x, y, colour, opacity: pixels that fills (part 0) and strokes (part 1) cover."""
    keys = [*by, "layer_id", "path_id"]
    paths = with_curves(paths)
    edges = outlines(flattened(paths, tolerance, keys), keys)
    looks = paths.where("path_id is not null").groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("fill", "stroke", "stroke_width", "opacity")))
    inked = looks.where("size(stroke) = 4 and stroke_width > 0").select(*keys, F.col("stroke").alias("colour"), "opacity", F.col("stroke_width").alias("width"))
    solid = looks.where("size(fill) = 4").select(*keys, F.col("fill").alias("colour"), "opacity")
    inside = filled(edges.join(solid.select(*keys), keys, "left_semi"), extents, by, keys).join(solid, keys).withColumn("part", F.lit(0))
    lines = stroked(edges.join(inked.select(*keys, "width"), keys), extents, by, keys).join(inked.drop("width"), keys).withColumn("part", F.lit(1))
    return inside.unionByName(lines)


def drawn(pixels: DataFrame, paths: DataFrame, by: list[str] = ["file_id"], extents: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:  # noqa: B006
    """``pixels`` (by, x, y, r, g, b, a) with paths (by, and the columns of ``container.CURVES``) over them.

    Layers in the order of their ids, paths in that of theirs, the stroke over the fill; each with the layer's opacity. ``extents`` are as
    for :func:`filled`, taken from the pixels if they are not given.
    """
    if extents is None:
        extents = pixels.groupBy(*by).agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    cover = coverage(paths, extents, by, tolerance)
    paints = cover.groupBy(*by, "x", "y").agg(F.array_sort(F.collect_list(F.struct("layer_id", "path_id", "part", "colour", "opacity"))).alias("paints"))
    below = F.array(*(F.col(c).cast("double") for c in "rgba"))

    def over(base: Column, p: Column) -> Column:
        share = p["colour"][3] * p["opacity"]
        colour = F.transform(F.slice(base, 1, 3), lambda v, i: F.floor(p["colour"][i] * 255.0 * share + v * (1 - share)).cast("double"))
        return F.concat(colour, F.array(F.greatest(base[3], F.floor(share * 255.0).cast("double"))))

    none = F.array().cast("array<struct<layer_id: bigint, path_id: bigint, part: int, colour: array<double>, opacity: double>>")
    rows = pixels.join(paints, [*by, "x", "y"], "left").withColumn("out", F.aggregate(F.coalesce("paints", none), below, over))
    return rows.select(*by, "x", "y", *(F.col("out")[n].cast("int").alias(c) for n, c in enumerate("rgba")))
