"""Boxes (id, x, y, w, h): predicates and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def overlaps(a: str, b: str) -> Column:
    """Strict overlap of the boxes of two aliases: boxes that touch do not overlap."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(a, "x") + c(a, "w") > c(b, "x")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(a, "y") + c(a, "h") > c(b, "y"))


def contains(x: Column, y: Column) -> Column:
    """Whether the row's box holds a point, all edges included."""
    return x.between(F.col("x"), F.col("x") + F.col("w")) & y.between(F.col("y"), F.col("y") + F.col("h"))


def with_cells(boxes: DataFrame, side: float) -> DataFrame:
    run = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / side), F.floor((F.col(at) + F.col(size)) / side)))
    return boxes.withColumn("cx", run("x", "w")).withColumn("cy", run("y", "h"))


def overlap_join(left: DataFrame, right: DataFrame, side: float = 64.0) -> DataFrame:
    """left_id, right_id of overlapping boxes, as an equi join on the cells of a grid.

    A pair meets in every cell that both cover and is kept in the one with the corner of its common part, so no
    pair is lost or doubled. ``side`` should be near the usual box; a box goes to as many cells as it covers.
    """
    a, b = with_cells(left, side).alias("a"), with_cells(right, side).alias("b")
    corner = lambda n: F.floor(F.greatest(F.col(f"a.{n}"), F.col(f"b.{n}")) / side)
    joined = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")))
    return joined.where(overlaps("a", "b") & (F.col("a.cx") == corner("x")) & (F.col("a.cy") == corner("y"))).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


def in_region(boxes: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Boxes that overlap one region."""
    return boxes.where((F.col("x") < x + w) & (F.col("x") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y") + F.col("h") > y))


def union_box(boxes: DataFrame, by: list[str] = ()) -> DataFrame:
    """The smallest box around all boxes of each group."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))


def triangles(boxes: DataFrame) -> DataFrame:
    """id, vertex, vx, vy: two triangles (six corners) for each box."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corners = [(F.col("x"), F.col("y")), (right, F.col("y")), (F.col("x"), bottom), (right, F.col("y")), (right, bottom), (F.col("x"), bottom)]
    rows = F.array(*(F.struct(F.lit(k).alias("vertex"), x.alias("vx"), y.alias("vy")) for k, (x, y) in enumerate(corners)))
    return boxes.select("id", F.inline(rows))


def device_coordinates(x: Column, y: Column, width: float, height: float) -> list[Column]:
    """Pixel coordinates as normalised device coordinates: -1 to 1, y upwards."""
    return [(x / width * 2 - 1).alias("nx"), (1 - y / height * 2).alias("ny")]


def scaled(boxes: DataFrame, x: float, y: float, level: int) -> DataFrame:
    """Boxes relative to (x, y) in pixels of a level."""
    k = 2.0**-level
    return boxes.select("id", ((F.col("x") - x) * k).alias("x"), ((F.col("y") - y) * k).alias("y"), (F.col("w") * k).alias("w"), (F.col("h") * k).alias("h"))


def whole(boxes: DataFrame, kind: str) -> DataFrame:
    """Float boxes as whole, not negative pixels with a region type."""
    return boxes.select("id", *(F.greatest(F.floor(c), F.lit(0)).cast("long").alias(c) for c in BOX), F.lit(kind).alias("region_type"))
