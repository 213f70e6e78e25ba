"""Closed contours as ordered points (contour_id, seq, x, y with seq from 0), and drawing paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(points: DataFrame) -> DataFrame:
    """Adds nx, ny: the next point; the last one meets the first."""
    per = Window.partitionBy("contour_id").orderBy("seq")
    whole = per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumns({f"n{c}": F.coalesce(F.lead(c).over(per), F.first(c).over(whole)) for c in ("x", "y")})


def measures(points: DataFrame) -> DataFrame:
    """contour_id, points, bounds (x, y, w, h), area (shoelace), perimeter, complexity and edge density.

    Complexity is the perimeter over that of a circle of the same area (null for area 0, 0 for perimeter 0);
    circularity is its inverse.
    """
    out = edges(points).groupBy("contour_id").agg(
        F.count("*").alias("points"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"),
        (F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"),
        F.sum(F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))).alias("perimeter"),
    )
    circle = 2 * math.pi * F.sqrt(F.col("area") / math.pi)
    complexity = F.when(F.col("perimeter") == 0, 0.0).otherwise(F.try_divide("perimeter", circle))
    density = F.when(F.col("w") * F.col("h") == 0, 0.0).otherwise(F.try_divide("perimeter", F.col("w") * F.col("h")))
    return out.withColumns({"complexity": complexity, "edge_density": density}).withColumn("circularity", F.try_divide(F.lit(1.0), "complexity"))


def kept(measured: DataFrame, least_points: int = 3, least_area: float = 100.0) -> DataFrame:
    return measured.where((F.col("points") >= least_points) & (F.col("area") >= least_area))


def region_type(measured: DataFrame, density: float = 0.3, complexity: float = 0.5) -> DataFrame:
    """Adds region_type by complexity and edge density."""
    vector = (F.col("complexity") < complexity) & (F.col("edge_density") > density)
    return measured.withColumn("region_type", F.when(vector, "vector").otherwise("raster"))


def points_inside(probes: DataFrame, points: DataFrame) -> DataFrame:
    """probe_id, contour_id of probes (probe_id, contour_id, px, py) inside their contour, by ray casting.

    Contours of fewer than three points hold nothing. Probes and edges meet on the contour, not in a cross join; probes outside of
    the contour's box meet no edge.
    """
    box = points.groupBy("contour_id").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    probes = probes.join(box, "contour_id").where("px >= lowx and px <= highx and py >= lowy and py <= highy").select("probe_id", "contour_id", "px", "py")
    lines = edges(points).withColumn("n", F.count("*").over(Window.partitionBy("contour_id"))).where("n >= 3")
    crosses = (F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))
    at = (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) / F.nullif(F.col("ny") - F.col("y"), F.lit(0.0)) + F.col("x")
    hits = F.count_if(crosses & (F.col("px") < at))
    return probes.join(lines, "contour_id").groupBy("probe_id", "contour_id").agg(hits.alias("hits")).where(F.col("hits") % 2 == 1).select("probe_id", "contour_id")


def path_commands(points: DataFrame) -> DataFrame:
    """path_id, seq, kind, x, y: a move, lines, and a close for more than three points; paths of up to two points go."""
    n = F.count("*").over(Window.partitionBy("contour_id"))
    rows = points.withColumn("n", n).where("n > 2")
    steps = rows.select(F.col("contour_id").alias("path_id"), F.col("seq").cast("long").alias("seq"), F.when(F.col("seq") == 0, "move").otherwise("line").alias("kind"), "x", "y")
    none = F.lit(None).cast("double")
    ends = rows.where("n > 3 and seq = 0").select(F.col("contour_id").alias("path_id"), F.col("n").cast("long").alias("seq"), F.lit("close").alias("kind"), none.alias("x"), none.alias("y"))
    return steps.unionByName(ends)


def moved(commands: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return commands.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def bezier(curves: DataFrame, steps: int = 8) -> DataFrame:
    """id, t, qx (quadratic with its first control point), cx (cubic): points of curves (id, p0, p1, p2, p3) in one coordinate."""
    t = F.col("k") / F.lit(float(steps))
    u = 1 - t
    rows = curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    quadratic = u * u * F.col("p0") + 2 * u * t * F.col("p1") + t * t * F.col("p2")
    cubic = u * u * u * F.col("p0") + 3 * u * u * t * F.col("p1") + 3 * u * t * t * F.col("p2") + t * t * t * F.col("p3")
    return rows.select("id", t.alias("t"), quadratic.alias("qx"), cubic.alias("cx"))


def segments(control: Column, whole: Column, tolerance: float, kind: Column) -> Column:
    """Into how many straight pieces a curve is cut: quadratic ones by how far the control point is from the middle, cubic ones by the way along the control points."""
    least = F.when(kind == "quadratic", 8.0).otherwise(16.0)
    return F.floor(F.greatest(least, F.when(kind == "quadratic", control).otherwise(whole) / tolerance)).cast("long")


def transform(x: Column, y: Column, width: Column, height: Column, scale: Column) -> Column:
    """The 4 x 4 matrix (by rows) that takes the region's pixels to device coordinates."""
    sx, sy, zero, one = 2.0 / width, 2.0 / height, F.lit(0.0), F.lit(1.0)
    return F.array(F.array(sx * scale, zero, zero, zero), F.array(zero, sy * scale, zero, zero), F.array(zero, zero, one, zero), F.array(-1.0 - x * sx, -1.0 - y * sy, zero, one))
