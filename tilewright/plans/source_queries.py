"""Queries on container files. They are made by the writer here from images of the embeddings; some are damaged."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions.session import with_checkpoints
from ..operators import encoder
from ..operators import tiles as T
from ..sources import container as S
from ..sources import images, ranged
from ..streaming import bandwidth as stream
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def grey_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's 8 x 8 image in four RGBA tiles of 4 x 4."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = np.floor((np.array(values, dtype=np.float64) + 1) * 127.5).astype(np.uint8).reshape(8, 8)
                image = np.stack((g, g, g, np.full_like(g, 255)), axis=2)
                for y in range(2):
                    for x in range(2):
                        for column, value in zip(out, (vec, x, y, image[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].tobytes())):
                            column.append(value)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([0] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in out[1:3]), pa.array([4] * n, pa.int32()), pa.array([4] * n, pa.int32()), pa.array(out[3], pa.binary())], ["file_id", "level", "x", "y", "width", "height", "rgba"])

    full = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    return full.mapInArrow(cut, "file_id long, level long, x long, y long, width int, height int, rgba binary")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the files: of image n its first n % 3 layers; layer k has k + 1 equal boxes from (k, 1) to (k + 3, 5)."""
    vec = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id")
    rows = vec.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int")))).where("k < vec_id % 3").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("k"))))
    corner = lambda seq, kind, x, y: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    left, right, none = F.col("k"), F.col("k") + 3, F.lit(None)
    box = F.array(corner(0, "move", left, F.lit(1)), corner(1, "line", right, F.lit(1)), corner(2, "line", right, F.lit(5)), corner(3, "line", left, F.lit(5)), corner(4, "close", none, none))
    fill = F.array(*(F.lit(1.0) for _ in range(4)))
    return rows.select(
        F.col("vec_id").alias("file_id"), F.col("k").cast("long").alias("layer_id"), F.concat(F.lit("layer "), F.col("k").cast("string")).alias("name"), F.lit(0.5).alias("opacity"), F.lit("normal").alias("blend_mode"),
        F.col("p").cast("long").alias("path_id"), fill.alias("fill"), F.explode(box).alias("c"),
    ).select("file_id", "layer_id", "name", "opacity", "blend_mode", "path_id", "fill", "c.*")


def files(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    tiles = S.encode_tiles(grey_tiles(spark, sf_dir))
    meta = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("file_id"), F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), F.lit(4).cast("long").alias("tile_size"), F.lit(0).alias("max_zoom_level"))
    return S.write_files(tiles, meta, layers(spark, sf_dir) if vectors is None else vectors)


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh file with a wrong magic number, every eleventh cut short, every thirteenth with its last byte changed."""
    f, c, k = files(spark, sf_dir), F.col("content"), F.col("file_id")
    body = F.when(k % 7 == 0, F.concat(F.lit(b"XXXX"), F.substring(c, F.lit(5), F.length(c)))).when(k % 11 == 0, F.substring(c, 1, 40)).when(k % 13 == 0, F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit(b"\x00"))).otherwise(c)
    return f.select("file_id", body.alias("content"))


@query("src1_open_files", "select vec_id as file_id, 8::bigint as width, 8::bigint as height, 4::bigint as tile_size, 4::bigint as tiles from embeddings where vec_id % 7 <> 0 and vec_id % 11 <> 0")
def open_files(spark, sf_dir):
    """Header, metadata and number of index entries of all sound files."""
    parts = S.sections(damaged(spark, sf_dir))
    counted = S.parse_index(parts).groupBy("file_id").agg(F.count("*").alias("tiles"))
    return S.parse_metadata(parts).select("file_id", "width", "height", "tile_size").join(counted, "file_id")


@query("src2_headers", "select vec_id as file_id, 1::bigint as version, 64::bigint as header_size, 64::bigint as metadata_offset, true as in_order from embeddings")
def headers(spark, sf_dir):
    h = S.headers(files(spark, sf_dir))
    order = (F.col("vector_offset") == 64 + F.col("metadata_size")) & (F.col("tile_index_offset") == F.col("vector_offset") + F.col("vector_size")) & (F.col("tile_data_offset") == F.col("tile_index_offset") + F.col("tile_index_size")) & (F.col("file_size") == F.col("length"))
    return h.select("file_id", "version", "header_size", "metadata_offset", order.alias("in_order"))


@query("src3_metadata", "select vec_id as file_id, 'Flate2' as vector_codec, 'Png' as raster_codec from embeddings")
def metadata(spark, sf_dir):
    return S.parse_metadata(S.sections(files(spark, sf_dir))).select("file_id", "vector_codec", "raster_codec")


@query("src5_tile_index", "select vec_id as file_id, 0::bigint as level, x, y, 64::bigint as uncompressed_size from embeddings, range(2) a(x), range(2) b(y)")
def tile_index(spark, sf_dir):
    return S.parse_index(S.sections(files(spark, sf_dir))).select("file_id", "level", "x", "y", "uncompressed_size")


def shared_folder(spark: SparkSession, name: str) -> str:
    folder = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    return f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def on_disk(spark: SparkSession, made: DataFrame, name: str) -> str:
    """The folder in the shared one that the files are written to, one each, named by their ids."""
    folder = shared_folder(spark, name)
    S.write_whole(made.withColumn("name", F.concat(F.col("file_id").cast("string"), F.lit(".bin"))), folder).count()
    return folder


def file_number(path: str = "path"):
    return F.regexp_extract(path, r"(-?[0-9]+)\.bin$", 1).cast("long").alias("file_id")


@query("src4_ranged_tiles", "select vec_id as file_id, 1::bigint as x, y // 4 as y, sum(g)::bigint as grey from (select vec_id, x, y::bigint as y, g from v_pixels) where x >= 4 and vec_id % 7 <> 0 and vec_id % 11 <> 0 and not (vec_id % 13 = 0 and y >= 4) group by vec_id, y // 4")
def ranged_tiles(spark, sf_dir):
    """The right half of every sound file's tiles, read by ranges from files on disk: other payloads are not read."""
    tiles = ranged.read_tiles(spark, on_disk(spark, damaged(spark, sf_dir), "ranged"), runBytes=1 << 20).where("level = 0 and x >= 1 and sound")
    shown = S.decode_tiles(tiles.select(file_number(), "level", "x", "y", "payload"))
    return S.tile_pixels(shown.withColumn("tile_size", F.lit(4))).groupBy("file_id", F.expr("x div 4").alias("x"), F.expr("y div 4").alias("y")).agg(F.sum("r").alias("grey"))


@query("src6_ranged_index", "select vec_id as file_id, case when vec_id % 7 = 0 then 'magic' when vec_id % 11 = 0 then 'short' end as error, case when vec_id % 7 <> 0 and vec_id % 11 <> 0 then 4 else 0 end::bigint as tiles from embeddings")
def ranged_index(spark, sf_dir):
    """Only headers and indexes of the files on disk: entries of each, and what is wrong with the others."""
    index = ranged.read_tiles(spark, on_disk(spark, damaged(spark, sf_dir), "ranged"), payloads=False)
    return index.groupBy(file_number()).agg(F.max("error").alias("error"), F.count("level").alias("tiles"))


@query("src8_checked_payloads", "select vec_id as file_id, x, y, not (vec_id % 13 = 0 and x = 1 and y = 1) as sound from embeddings, range(2) a(x), range(2) b(y) where vec_id % 7 <> 0 and vec_id % 11 <> 0")
def checked_payloads(spark, sf_dir):
    return S.payloads(S.sections(damaged(spark, sf_dir))).select("file_id", "x", "y", "sound")


@query("src10_vector_layers", "select vec_id as file_id, (vec_id % 3)::bigint as layers from embeddings")
def vector_layers(spark, sf_dir):
    return S.parse_vectors(S.sections(files(spark, sf_dir))).where("error is null").select("file_id", "layers")


DRAWN = "(select vec_id, k, p from embeddings, range(2) a(k), range(2) b(p) where k < vec_id % 3 and p <= k)"


@query("dec2_path_commands", f"select vec_id as file_id, k::bigint as layer_id, p::bigint as path_id, c.seq::bigint as seq, c.kind, (k + c.dx)::double as x, c.y::double as y from {DRAWN}, (values (0, 'move', 0, 1), (1, 'line', 3, 1), (2, 'line', 3, 5), (3, 'line', 0, 5), (4, 'close', null, null)) c(seq, kind, dx, y)")
def path_commands(spark, sf_dir):
    """The commands of all paths, read back from the vector sections."""
    return S.parse_paths(S.sections(files(spark, sf_dir))).select("file_id", "layer_id", "path_id", "seq", "kind", "x", "y")


@query("flt11_vector_rules", f"select vec_id as file_id, k::bigint as layer_id, null::bigint as path_id, 'opacity' as code from (select distinct vec_id, k from {DRAWN}) where vec_id % 5 = 1 union all select vec_id, k, p, case vec_id % 5 when 2 then 'no_move' when 3 then 'coordinate' else 'after_close' end from {DRAWN} where vec_id % 5 in (2, 3, 4)")
def vector_rules(spark, sf_dir):
    """Rules that layers and paths break: every fifth file is wrong in one way, others in another."""
    n, seq = F.col("file_id") % 5, F.col("seq")
    v = layers(spark, sf_dir)
    v = v.withColumn("opacity", F.when(n == 1, 1.5).otherwise(F.col("opacity"))).where(~((n == 2) & (seq == 0)))
    v = v.withColumn("x", F.when((n == 3) & (seq == 1), F.lit("NaN").cast("double")).otherwise(F.col("x")))
    v = v.withColumn("seq", F.when((n == 4) & (F.col("kind") == "close"), 2).when((n == 4) & (seq > 1), seq + 1).otherwise(seq))
    return S.vector_violations(S.parse_paths(S.sections(files(spark, sf_dir, v))))


@query("flt14_input_rules", "select p_partkey, case when p_partkey % 11 = 0 then 'unreadable' when p_partkey % 4 = 0 then 'size_differs' when p_partkey % 6 = 1 then 'dimension_too_large' end as code from part")
def input_rules(spark, sf_dir):
    k = F.col("p_partkey")
    width = F.when(k % 11 == 0, None).when(k % 6 == 1, 70000).otherwise(k % 3000 + 1)
    return V.table(spark, sf_dir, "part").select("p_partkey", images.input_violation(width, F.lit(100), F.when(k % 4 == 0, width + 1).otherwise(width), F.lit(100)).alias("code"))


@query("snk13_extracted_paths", "select vec_id as file_id, 'file_' || vec_id || '/level_0/tile_' || x || '_' || y || '.png' as path from embeddings, range(2) a(x), range(2) b(y)")
def extracted_paths(spark, sf_dir):
    """Where the tiles of all levels go when several files are extracted."""
    return S.tile_paths(S.payloads(S.sections(files(spark, sf_dir))).where("sound"), True).select("file_id", "path")


INSIDE = "(p.x >= k and p.x < k + 3 and p.y >= 1 and p.y < 5)"


@query("rnd1_rendered_region", f"with recursive base as (select vec_id, x, y, g as v, 0 as step from v_pixels where x between 2 and 6 and y between 0 and 5), paints as (select vec_id, k, row_number() over (partition by vec_id order by k, p) as n from {DRAWN}), r as (select * from base union all select p.vec_id, p.x, p.y, case when {INSIDE} then floor(255.0::double * 0.5::double + p.v * 0.5::double)::int else p.v end, p.step + 1 from r p join paints on paints.vec_id = p.vec_id and paints.n = p.step + 1) select vec_id as file_id, x::bigint as x, y::bigint as y, arg_max(v, step)::int as r, 255 as a from r group by vec_id, x, y")
def rendered_region(spark, sf_dir):
    """A region of every file with its vector layers drawn over the tiles."""
    f = files(spark, sf_dir)
    regions = meta_of(spark, sf_dir, 0).select("file_id", *(F.lit(v).cast("long").alias(n) for n, v in (("level", 0), ("rx", 2), ("ry", 0), ("rw", 5), ("rh", 6))))
    return encoder.render(f, regions).select("file_id", "x", "y", "r", "a")


def sparse_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels 0, 1 and 2 of the 8 x 8 images in tiles of 4 (each level the upper left pixels of the one below); some tiles are not there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = np.floor((np.array(values, dtype=np.float64) + 1) * 127.5).astype(np.uint8).reshape(8, 8)
                lacking = {place for every, place in ((3, (0, 1, 0)), (5, (0, 0, 1)), (2, (1, 0, 0))) if vec % every == 0}
                for level in range(3):
                    small = g[:: 1 << level, :: 1 << level]
                    image = np.stack((small, small, small, np.full_like(small, 255)), axis=2)
                    for y in range(-(-len(small) // 4)):
                        for x in range(-(-len(small) // 4)):
                            if (level, x, y) not in lacking:
                                part = image[4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
                                rows.append((vec, level, x, y, part.shape[1], part.shape[0], part.tobytes()))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], ["file_id", "level", "x", "y", "width", "height", "rgba"])

    full = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    return full.mapInArrow(cut, encoder.TILES)


def meta_of(spark: SparkSession, sf_dir: str, zoom: int) -> DataFrame:
    sizes = {"width": 8, "height": 8, "tile_size": 4}
    return V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("file_id"), *(F.lit(n).cast("long").alias(c) for c, n in sizes.items()), F.lit(zoom).alias("max_zoom_level"))


SHRUNK = "(p.x + 0.5::double >= k * f and p.x + 0.5::double < (k + 3) * f and p.y + 0.5::double >= f and p.y + 0.5::double < 5 * f)"


@query(
    "rnd1_levels",
    f"""with recursive cells as (select vec_id, l, x, y, 1.0::double / (1 << l) as f,
  case when l = 0 and not (vec_id % 3 = 0 and x >= 4 and y < 4) and not (vec_id % 5 = 0 and x < 4 and y >= 4) then 0 when vec_id % 2 <> 0 then 1 else 2 end as h
  from (select distinct vec_id from v_pixels), range(2) t(l), range(8) a(x), range(8) b(y) where x < 8 >> l and y < 8 >> l),
base as (select c.vec_id, c.l, c.x, c.y, c.f, c.h, p.g as v, 0 as step from cells c join v_pixels p on p.vec_id = c.vec_id and p.x = (c.x >> (c.h - c.l)) << c.h and p.y = (c.y >> (c.h - c.l)) << c.h),
paints as (select vec_id, k, row_number() over (partition by vec_id order by k, p) as n from {DRAWN}),
r as (select * from base union all select p.vec_id, p.l, p.x, p.y, p.f, p.h, case when {SHRUNK} then floor(255.0::double * 0.5::double + p.v * 0.5::double)::int else p.v end, p.step + 1 from r p join paints on paints.vec_id = p.vec_id and paints.n = p.step + 1)
select vec_id as file_id, l::bigint as level, x::bigint as x, y::bigint as y, arg_max(v, step)::int as r, 255 as a from r group by vec_id, l, x, y""",
)
def rendered_levels(spark, sf_dir):
    """Levels 0 and 1 of every file, from coarser ones where tiles are lacking, with the layers at their scale."""
    f = S.write_files(S.encode_tiles(sparse_tiles(spark, sf_dir)), meta_of(spark, sf_dir, 2), layers(spark, sf_dir))
    level = meta_of(spark, sf_dir, 2).select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("level"))
    side = F.when(F.col("level") == 0, 8).otherwise(4).cast("long")
    regions = level.select("file_id", "level", F.lit(0).cast("long").alias("rx"), F.lit(0).cast("long").alias("ry"), side.alias("rw"), side.alias("rh"))
    return encoder.render(f, regions).select("file_id", "level", "x", "y", "r", "a")


# Commands of the curved paths: path, seq, kind, x, y, x1, y1, x2, y2. The control point of the quadratic one moves with the file.
SHAPES = [
    (0, 0, "move", 1.0, 1.0, None, None, None, None), (0, 1, "quadratic", 6.5, 3.0, 4.0, -1.0, None, None), (0, 2, "cubic", 1.5, 6.0, 9.0, 5.0, 3.0, 9.0), (0, 3, "close", None, None, None, None, None, None),
    (1, 0, "move", 0.5, 7.0, None, None, None, None), (1, 1, "line", 7.0, 0.5, None, None, None, None), (1, 2, "quadratic", 7.5, 7.5, 5.0, 5.0, None, None),
]
FILL, INK = (1.0, 0.5, 0.0, 1.0), (0.0, 0.25, 1.0, 0.75)


def curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``container.CURVES`` of every image: a filled shape of two curves, with a stroke in every second file; in every fourth an open stroke over it."""
    made = spark.createDataFrame(SHAPES, "path_id long, seq long, kind string, x double, y double, x1 double, y1 double, x2 double, y2 double")
    vec = V.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id")
    colour = lambda values: F.array(*map(F.lit, values))
    rows = vec.join(F.broadcast(made), F.expr("path_id = 0 or vec_id % 4 = 1"))  # a fixed list of seven commands
    inked = (F.col("path_id") == 1) | (F.col("vec_id") % 2 == 0)
    return rows.select(
        F.col("vec_id").alias("file_id"), F.lit(0).cast("long").alias("layer_id"), F.lit("curves").alias("name"), F.lit(0.5).alias("opacity"), F.lit("normal").alias("blend_mode"), "path_id",
        F.when(F.col("path_id") == 0, colour(FILL)).otherwise(F.array().cast("array<double>")).alias("fill"), "seq", "kind", "x", "y",
        F.when((F.col("kind") == "quadratic") & (F.col("path_id") == 0), F.col("x1") + F.col("vec_id") % 3).otherwise(F.col("x1")).alias("x1"), "y1", "x2", "y2",
        F.when(inked, colour(INK)).alias("stroke"), F.when(inked, F.col("path_id") * 0.75 + 1.25).otherwise(0.0).alias("stroke_width"),
    )


def _sql_value(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"{v!r}::double"


CURVED = f"""(select vec_id, path, seq, kind, x, y, case when kind = 'quadratic' and path = 0 then x1 + vec_id % 3 else x1 end as x1, y1, x2, y2,
  path = 1 or vec_id % 2 = 0 as inked from embeddings, (values {", ".join("(" + ", ".join(map(_sql_value, c)) + ")" for c in SHAPES)}) c(path, seq, kind, x, y, x1, y1, x2, y2) where path = 0 or vec_id % 4 = 1)"""


@query("dec2_curves", f"select vec_id as file_id, path::bigint as path_id, seq::bigint as seq, kind, x, y, x1, y1, x2, y2, case when inked then '{list(INK)}' end as stroke, case when inked then path * 0.75::double + 1.25::double else 0.0::double end as stroke_width from {CURVED}")
def curve_commands(spark, sf_dir):
    """Curves with their control points and strokes, written to the vector sections and read back."""
    read = S.parse_paths(S.sections(files(spark, sf_dir, curved(spark, sf_dir))))
    return read.select("file_id", "path_id", "seq", "kind", "x", "y", "x1", "y1", "x2", "y2", F.when(F.col("stroke").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("stroke", lambda v: v.cast("string")), ", "), F.lit("]"))).alias("stroke"), "stroke_width")


def _over(v: str, colour: float, alpha: float, hit: str) -> str:
    share = f"({alpha!r}::double * 0.5::double)"
    return f"(case when {hit} then floor({colour!r}::double * 255.0::double * {share} + {v} * (1 - {share})) else {v} end)"


def _painted(c: int) -> str:
    return _over(_over(_over("g", FILL[c], FILL[3], "f0"), INK[c], INK[3], "s0"), INK[c], INK[3], "s1")


_LENGTH = "sqrt(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"
CURVED_PIXELS = f"""with c as (select vec_id, path, seq, kind, x, y, x1, y1, x2, y2, lag(x) over w as sx, lag(y) over w as sy, bool_or(kind = 'close') over (partition by vec_id, path) as closed, inked from {CURVED} window w as (partition by vec_id, path order by seq)),
n as (select *, case kind when 'quadratic' then floor(greatest(8.0::double, sqrt(((sx + x) * 0.5::double - x1) * ((sx + x) * 0.5::double - x1) + ((sy + y) * 0.5::double - y1) * ((sy + y) * 0.5::double - y1)) / 0.25::double))
  when 'cubic' then floor(greatest(16.0::double, (sqrt((x1 - sx) * (x1 - sx) + (y1 - sy) * (y1 - sy)) + sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) + sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))) / 0.25::double)) else 1 end::bigint as n from c where kind <> 'close'),
k as (select *, k / n::double as t, 1 - k / n::double as u from (select *, unnest(range(1, n + 1)) as k from n)),
corners as (select vec_id, path, seq, k, closed, inked,
  case kind when 'quadratic' then u * u * sx + 2 * u * t * x1 + t * t * x when 'cubic' then u * u * u * sx + 3 * u * u * t * x1 + 3 * u * t * t * x2 + t * t * t * x else x end as x,
  case kind when 'quadratic' then u * u * sy + 2 * u * t * y1 + t * t * y when 'cubic' then u * u * u * sy + 3 * u * u * t * y1 + 3 * u * t * t * y2 + t * t * t * y else y end as y from k),
edges as (select vec_id, path, inked, path * 0.75::double + 1.25::double as width, x, y, coalesce(lead(x) over w, first(x) over w) as nx, coalesce(lead(y) over w, first(y) over w) as ny, closed or lead(x) over w is not null as drawn
  from corners window w as (partition by vec_id, path order by seq, k rows between unbounded preceding and unbounded following)),
met as (select p.vec_id, p.x, p.y, p.g, e.path, (e.y > p.y + 0.5::double) <> (e.ny > p.y + 0.5::double) and p.x + 0.5::double < (e.nx - e.x) * (p.y + 0.5::double - e.y) / nullif(e.ny - e.y, 0) + e.x as crossed,
  e.inked and e.drawn and (p.x + 0.5::double - (e.x + t * (e.nx - e.x))) * (p.x + 0.5::double - (e.x + t * (e.nx - e.x))) + (p.y + 0.5::double - (e.y + t * (e.ny - e.y))) * (p.y + 0.5::double - (e.y + t * (e.ny - e.y))) <= width / 2 * (width / 2) as near
  from v_pixels p join (select * from edges) e on e.vec_id = p.vec_id, lateral (select least(greatest(((p.x + 0.5::double - e.x) * (e.nx - e.x) + (p.y + 0.5::double - e.y) * (e.ny - e.y)) / ((e.nx - e.x) * (e.nx - e.x) + (e.ny - e.y) * (e.ny - e.y)), 0.0::double), 1.0::double) as t)),
hits as (select vec_id, x, y, g, count(*) filter (path = 0 and crossed) % 2 = 1 as f0, coalesce(bool_or(near) filter (path = 0), false) as s0, coalesce(bool_or(near) filter (path = 1), false) as s1 from met group by vec_id, x, y, g)
select vec_id as file_id, x::bigint as x, y::bigint as y, {_painted(0)}::int as r, {_painted(1)}::int as g, {_painted(2)}::int as b from hits"""


@query("rnd2_curves", CURVED_PIXELS)
def rendered_curves(spark, sf_dir):
    """Every image with curved fills and strokes over it, from its file."""
    f = files(spark, sf_dir, curved(spark, sf_dir))
    regions = meta_of(spark, sf_dir, 0).select("file_id", *(F.lit(v).cast("long").alias(n) for n, v in (("level", 0), ("rx", 0), ("ry", 0), ("rw", 8), ("rh", 8))))
    return encoder.render(f, regions).select("file_id", "x", "y", "r", "g", "b")


@query("gen5_encoded_pyramid", "select vec_id as file_id, 0::bigint as level, (x // 4)::bigint as x, (y // 4)::bigint as y, 4::int as width, 4::int as height, sum(r)::bigint as r, sum(g)::bigint as g, sum(b)::bigint as b, sum(a)::bigint as a from v_rgba group by vec_id, x // 4, y // 4 having sum(a) > 0")
def encoded_pyramid(spark, sf_dir):
    """Tiles of level 0 of encoded colour images, those with a visible pixel: their sides and the sums of their decoded pixels."""
    tiles = S.decode_tiles(S.payloads(S.sections(encoder.encode(colour_images(spark, sf_dir), 4, 1))).where("level = 0 and sound"))
    sums = S.tile_pixels(tiles.withColumn("tile_size", F.lit(4))).groupBy("file_id", F.expr("x div 4").alias("x"), F.expr("y div 4").alias("y")).agg(*(F.sum(c).alias(c) for c in "rgba"))
    return tiles.select("file_id", "level", "x", "y", "width", "height").join(sums, ["file_id", "x", "y"]).select("file_id", "level", "x", "y", "width", "height", *"rgba")


@query("gen6_traced_paths")
def traced_paths(spark, sf_dir):
    """Paths over the edges of encoded images, read back from their files."""
    made = encoder.encode(colour_images(spark, sf_dir), 4, 1, 20, 40)
    return S.parse_paths(S.sections(made)).groupBy("file_id").agg(F.countDistinct("path_id").alias("paths"), F.count("*").alias("commands"))


def colour_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour images of the embeddings as rows (id, width, height, rgba)."""
    byte = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    cells = V.rgba(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*(byte(c) for c in "rgba")).alias("h")))).alias("cells"))
    return cells.where(F.size("cells") == 64).select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join("cells.h", "")).alias("rgba"))


@query("prj16_tile_dimensions", "select vec_id as file_id, x, y, 4::int as width, 4::int as height from embeddings, range(2) a(x), range(2) b(y)")
def tile_dimensions(spark, sf_dir):
    return S.decode_tiles(S.payloads(S.sections(files(spark, sf_dir)))).select("file_id", "x", "y", "width", "height")


@query("gen16_encoded_files", "select vec_id as file_id, true as whole from embeddings")
def encoded_files(spark, sf_dir):
    """Images to files: all payloads there, their sizes adding up to the file's."""
    parts = S.sections(files(spark, sf_dir))
    size = S.parse_index(parts).groupBy("file_id").agg(F.sum("size").alias("bytes"))
    return parts.join(size, "file_id").select("file_id", (F.col("tile_data_offset") + F.col("bytes") == F.length("content")).alias("whole"))


@query("src17_sniffed", "select vec_id as file_id, vec_id % 7 <> 0 as ours from embeddings")
def sniffed(spark, sf_dir):
    return damaged(spark, sf_dir).select("file_id", S.is_container(F.col("content")).alias("ours"))


@query("flt6_header_rules", "select vec_id as file_id, case when vec_id % 7 = 0 then 'magic' when vec_id % 11 = 0 then 'short' end as code from embeddings")
def header_rules(spark, sf_dir):
    return S.headers(damaged(spark, sf_dir)).select("file_id", S.header_violation().alias("code"))


@query("snk10_decoded_pixels", "select vec_id as file_id, x, y, g from v_pixels")
def decoded_pixels(spark, sf_dir):
    """Written, read, checked and decoded again: the pixels of the images."""
    tiles = S.decode_tiles(S.payloads(S.sections(files(spark, sf_dir))).where("sound"))
    return S.tile_pixels(tiles.withColumn("tile_size", F.lit(4))).select("file_id", F.col("x").cast("int"), F.col("y").cast("int"), F.col("r").alias("g"))


@query("snk8_jpeg_tiles", "select vec_id as file_id, 'Jpeg' as codec, x, y, g, true as near from v_pixels")
def jpeg_tiles(spark, sf_dir):
    """The tiles of files with JPEG payloads, decoded by Spark's image source: each pixel beside the one that was encoded, within what steps of 1 allow."""
    folder, meta = shared_folder(spark, "jpeg"), meta_of(spark, sf_dir, 0)
    # Milliseconds a tile: dealt out, and made once.
    grey = grey_tiles(spark, sf_dir).repartition(max(spark.sparkContext.defaultParallelism, meta.count() // 500))
    parts = S.sections(S.write_files(S.encode_tiles(grey, 100), meta, quality=100).checkpoint())
    name = F.concat_ws("_", F.col("file_id").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    payloads = S.payloads(parts).where("sound").select(F.concat(name, F.lit(".jpg")).alias("name"), F.col("payload").alias("content"))
    place = F.split(F.regexp_extract("path", r"([^/]*)\.jpg$", 1), "_")
    tiles = images.through_files(payloads, folder).select(*(place[k].cast("long").alias(c) for k, c in enumerate(("file_id", "x", "y"))), "width", "height", "rgba", F.lit(4).alias("tile_size"))
    pixels = S.tile_pixels(tiles).select("file_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "r")
    source = V.pixels(spark, sf_dir).withColumnRenamed("vec_id", "file_id")
    codec = S.parse_metadata(parts).select("file_id", F.col("raster_codec").alias("codec"))
    # Pixels look few to a planner, who knows the images only.
    met = source.hint("merge").join(pixels, ["file_id", "x", "y"]).hint("merge").join(codec, "file_id")
    return met.select("file_id", "codec", "x", "y", "g", (F.abs(F.col("g") - F.col("r")) <= 2).alias("near"))


@query("snk12_level_tiles", "select x::bigint as x, y::bigint as y, count(*) as files from embeddings, range(2) a(x), range(2) b(y) group by all")
def level_tiles(spark, sf_dir):
    """The tiles of a level that the files hold."""
    index = S.parse_index(S.sections(files(spark, sf_dir))).where("level = 0")
    cells = spark.range(4).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return cells.join(index, ["x", "y"]).groupBy("x", "y").agg(F.count("*").alias("files"))


@query("snk14_metadata_json", """select vec_id as file_id, '{"width":8,"height":8,"tile_size":4}' as json from embeddings""")
def metadata_json(spark, sf_dir):
    m = S.parse_metadata(S.sections(files(spark, sf_dir)))
    return m.select("file_id", F.to_json(F.struct("width", "height", "tile_size")).alias("json"))


@query("snk15_info_json", """select vec_id as file_id, '{"dimensions":{"width":8,"height":8},"tiles":4}' as json from embeddings""")
def info_json(spark, sf_dir):
    parts = S.sections(files(spark, sf_dir))
    counted = S.parse_index(parts).groupBy("file_id").agg(F.count("*").alias("tiles"))
    m = S.parse_metadata(parts).join(counted, "file_id")
    return m.select("file_id", F.to_json(F.struct(F.struct("width", "height").alias("dimensions"), "tiles")).alias("json"))


@query("udf11_identity_codec", "select doc_id, n_chars from documents")
def identity_codec(spark, sf_dir):
    codec = plugins.REGISTRY.get("identity", "compression")
    d = V.table(spark, sf_dir, "documents")
    back = codec.decompress(codec.compress(F.encode("text", "UTF-8")))
    return d.select("doc_id", F.length(F.decode(back, "UTF-8")).cast("long").alias("n_chars"))


@query("snk6_deflate_round_trip", "select doc_id, sha256(text) as digest from documents")
def deflate_round_trip(spark, sf_dir):
    codec = plugins.Deflate()
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(codec.decompress(codec.compress(F.encode("text", "UTF-8"))), 256).alias("digest"))


@query("str9_bandwidth_stream", "with recursive o as (select client, (bytes * 1000000 // duration_us)::bigint as bps, row_number() over (partition by client order by us, event_id) as n from v_transfers), e as (select distinct client, 0::bigint as n, 1000000::bigint as ema from o union all select e.client, o.n, floor(e.ema * 0.8::double + o.bps * 0.2::double)::bigint from e join o on o.client = e.client and o.n = e.n + 1) select client, arg_max(ema, n) as ema, max(n) as samples from e group by client")
def bandwidth_stream(spark, sf_dir):
    """The running bandwidth of each client from a stream of transfers, run to its end."""
    return stream.last_states(spark, sf_dir)
