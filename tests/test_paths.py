"""Curves and strokes against plain rasters: every pixel with every edge."""

import math

import numpy as np
import pytest

from tilewright.operators import paths as P
from tilewright.sources import codecs
from tilewright.sources import container as S


def plain_corners(commands, tolerance):
    """Subpaths of (corners, closed) of one path."""
    out, now = [], None
    for kind, x, y, x1, y1, x2, y2 in commands:
        if kind == "close":
            out[-1][1] = True
            continue
        if kind == "move":
            out.append([[(x, y)], False])
        else:
            sx, sy = now
            n = 1
            if kind == "quadratic":
                n = math.floor(max(8.0, math.dist((x1, y1), ((sx + x) * 0.5, (sy + y) * 0.5)) / tolerance))
            elif kind == "cubic":
                n = math.floor(max(16.0, (math.dist((sx, sy), (x1, y1)) + math.dist((x1, y1), (x2, y2)) + math.dist((x2, y2), (x, y))) / tolerance))
            for k in range(1, n + 1):
                t = k / n
                u = 1 - t
                if kind == "quadratic":
                    p = [u * u * a + 2 * u * t * b + t * t * c for a, b, c in ((sx, x1, x), (sy, y1, y))]
                elif kind == "cubic":
                    p = [u**3 * a + 3 * u * u * t * b + 3 * u * t * t * c + t**3 * d for a, b, c, d in ((sx, x1, x2, x), (sy, y1, y2, y))]
                else:
                    p = [x, y]
                out[-1][0].append(tuple(p))
        now = (x, y)
    return out


def plain_cover(commands, width, x, y, tolerance=P.TOLERANCE):
    px, py = x + 0.5, y + 0.5
    crossings, near = 0, math.inf
    for corners, closed in plain_corners(commands, tolerance):
        for k, (ax, ay) in enumerate(corners):
            bx, by = corners[(k + 1) % len(corners)]
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                crossings += 1
            if k + 1 < len(corners) or closed:
                dx, dy = bx - ax, by - ay
                t = min(max(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
                near = min(near, math.dist((px, py), (ax + t * dx, ay + t * dy)))
    return crossings % 2 == 1, near, width / 2


def random_paths(seed, n=12, side=24):
    rng = np.random.default_rng(seed)
    point = lambda: [float(v) for v in np.round(rng.uniform(-4, side + 4, 2), 3)]
    out = []
    for _ in range(n):
        commands = []
        for _ in range(int(rng.integers(1, 3))):
            commands.append(("move", *point(), None, None, None, None))
            for _ in range(int(rng.integers(1, 4))):
                kind = str(rng.choice(["line", "quadratic", "cubic"]))
                commands.append((kind, *point(), *(point() if kind != "line" else (None, None)), *(point() if kind == "cubic" else (None, None))))
            if rng.random() < 0.5:
                commands.append(("close", *[None] * 6))
        out.append((commands, float(rng.choice([0.0, 0.7, 2.5, 9.0]))))
    return out


def rows_of(made, file_id=1):
    out = []
    for p, (commands, width) in enumerate(made):
        for seq, (kind, x, y, *controls) in enumerate(commands):
            out.append((file_id, p % 2, "l", 0.5, "normal", p, [1.0, 0.0, 0.0, 1.0] if p % 3 else [], seq, kind, x, y, *controls, [0.0, 0.0, 1.0, 0.5] if width else None, width))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_is_that_of_every_pixel(spark, seed):
    made, side = random_paths(seed), 24
    extents = spark.createDataFrame([(1, 0, side - 1, 0, side - 1)], "file_id long, lowx long, highx long, lowy long, highy long")
    got = {}
    for r in P.coverage(spark.createDataFrame(rows_of(made), S.CURVES), extents, ["file_id"]).collect():
        got.setdefault((r.path_id, r.part), set()).add((r.x, r.y))
    for p, (commands, width) in enumerate(made):
        for x in range(side):
            for y in range(side):
                inside, near, half = plain_cover(commands, width, x, y)
                assert ((x, y) in got.get((p, 0), ())) == (inside and bool(p % 3)), (p, x, y)
                if width and abs(near - half) > 1e-9:
                    assert ((x, y) in got.get((p, 1), ())) == (near < half), (p, x, y)


def test_write_read_write_read_gives_equal_rows(spark):
    rows = rows_of(random_paths(3)) + rows_of(random_paths(4), 2)
    meta = spark.createDataFrame([(1, 24, 24, 64, 0), (2, 24, 24, 64, 0)], "file_id long, width long, height long, tile_size long, max_zoom_level int")
    none = spark.createDataFrame([], "file_id long, level long, x long, y long, payload binary, uncompressed_size long")
    files = S.write_files(none, meta, spark.createDataFrame(rows, S.CURVES))
    once = S.parse_paths(S.sections(files))
    again = S.parse_paths(S.sections(S.write_files(none, meta, once)))
    order = lambda df: sorted(map(str, df.select(*S.CURVE_NAMES).collect()))
    # Layers and paths are numbered anew in a file: by their order.
    assert order(once) == order(again) and once.count() == len(rows)
    assert {r.code for r in S.vector_violations(once).collect()} == {"after_close"}  # subpaths go on behind a close
    kinds = {(r.kind, r.x1 is None, r.x2 is None) for r in once.collect()}
    assert kinds <= {("move", True, True), ("line", True, True), ("close", True, True), ("quadratic", False, True), ("cubic", False, False)} and len(kinds) == 5


def test_lost_control_points_are_told_and_drawn_as_lines(spark):
    rows = [(1, 0, "l", 1.0, "normal", 0, [1.0] * 4, k, kind, x, y, *c, None, 0.0) for k, (kind, x, y, c) in enumerate([("move", 1.0, 1.0, [None] * 4), ("quadratic", 9.0, 1.0, [None] * 4), ("cubic", 9.0, 9.0, [1.0, 1.0, None, 2.0]), ("line", 1.0, 9.0, [None] * 4)])]
    df = spark.createDataFrame(rows, S.CURVES)
    assert [(r.path_id, r.code) for r in S.vector_violations(df).collect()] == [(0, "coordinate")]
    assert [(r.x, r.y) for r in P.flattened(df).orderBy("seq").collect()] == [(1, 1), (9, 1), (9, 9), (1, 9)]
    odd = df.selectExpr("*", "if(seq = 2, double('NaN'), x) as nx").drop("x").withColumnRenamed("nx", "x")
    assert P.flattened(odd).count() == 0


def test_a_section_of_another_writer(spark):
    """Curves as other encoders write them: fields in any order, no fill."""
    path = {"commands": [{"MoveTo": {"x": 0, "y": 0}}, {"CubicTo": {"y2": 4.0, "x2": 3.0, "x1": 1.0, "y1": 2.0, "y": 6.0, "x": 5.0}}], "fill": None, "stroke": [0, 0, 0, 1], "stroke_width": 2, "bounds": {}}
    data = codecs.deflate(codecs.to_cbor({"layers": [{"name": "n", "paths": [path], "opacity": 1, "blend_mode": "SoftLight", "bounds": {}}], "bounds": {}}))
    got = S.parse_paths(spark.createDataFrame([(1, data)], "file_id long, vectors binary")).orderBy("seq").collect()
    assert (got[1].x1, got[1].y1, got[1].x2, got[1].y2, got[1].x, got[1].y) == (1, 2, 3, 4, 5, 6)
    assert got[0].fill == [] and got[0].stroke == [0, 0, 0, 1] and got[0].stroke_width == 2
