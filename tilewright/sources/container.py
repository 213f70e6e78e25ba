"""The tiled image container as tables: read with column expressions, written by Arrow tasks.

A file is a 64-byte header, CBOR metadata, a vector section, a tile index and the tile payloads, all numbers
little-endian. Files come as rows (file_id, content), from ``binaryFile`` or any table. Reading never fails a
job: damage becomes rows of violations.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import little_endian
from . import codecs, jpeg

# Fixed values of the format: the magic number, the version, sizes of header and index entry, places of fields.
MAGIC_HEX = "56455241"
VERSION, HEADER_BYTES, ENTRY_BYTES = 1, 64, 29
HEADER = {
    "version": (4, 4), "header_size": (8, 4), "metadata_offset": (12, 8), "metadata_size": (20, 4), "vector_offset": (24, 8), "vector_size": (32, 4),
    "tile_index_offset": (36, 8), "tile_index_size": (44, 4), "tile_data_offset": (48, 8), "file_size": (56, 8),
}
ENTRY = {"level": (0, 1), "x": (1, 4), "y": (5, 4), "offset": (9, 8), "size": (17, 4), "uncompressed_size": (21, 4), "checksum": (25, 4)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id (hash of the path), path and content of the files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file_id"), "path", "content")


def is_container(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == MAGIC_HEX


def headers(files: DataFrame, *more: str) -> DataFrame:
    """file_id, ``more`` columns, magic, the header's fields and the length; nulls behind the end of a short file."""
    content = F.col("content")
    fields = [F.when(F.length(content) >= at + n, little_endian(content, at, n)).alias(name) for name, (at, n) in HEADER.items()]
    # Inlined, so that each field is computed once and conditions on it do not repeat how.
    return files.select("file_id", *more, F.substring(content, 1, 4).alias("magic"), F.inline(F.array(F.struct(*fields, F.length(content).cast("long").alias("length")))))


def header_violation() -> Column:
    """The first rule that a header row breaks, or null. Sections must lie in the file."""
    inside = lambda at, n: F.coalesce(F.try_add(F.col(at), F.col(n)) <= F.col("length"), F.lit(False))
    return (
        F.when(F.col("length") < HEADER_BYTES, "short")
        .when(F.hex("magic") != MAGIC_HEX, "magic")
        .when(F.col("version") > VERSION, "version")
        .when(F.col("header_size") != HEADER_BYTES, "header_size")
        .when(F.coalesce(F.col("metadata_offset") < F.col("header_size"), F.lit(True)), "metadata_offset")
        .when(~inside("metadata_offset", "metadata_size") | ~inside("vector_offset", "vector_size") | ~inside("tile_index_offset", "tile_index_size"), "section")
    )


def section(content: Column, offset: Column, size: Column) -> Column:
    return F.substring(content, F.try_add(offset, F.lit(1)).try_cast("int"), size.try_cast("int"))


def sections(files: DataFrame) -> DataFrame:
    """file_id, header fields, content, metadata, vectors, index: the sections of sound files."""
    head = headers(files, "content").where(header_violation().isNull()).drop("magic", "length")
    cut = lambda name: section(F.col("content"), F.col(f"{name}_offset"), F.col(f"{name}_size"))
    return head.withColumns({"metadata": cut("metadata"), "vectors": cut("vector"), "index": cut("tile_index")})


def parse_index(parts: DataFrame, column: str = "index") -> DataFrame:
    """file_id and one row for each entry of a packed index: a count, then 29 bytes each. Other lengths give no rows."""
    n = little_endian(F.col(column), 0, 4)
    sound = parts.where(F.length(column) >= 4).withColumn("n", n).where((F.col("n") > 0) & (F.length(column) == 4 + ENTRY_BYTES * F.col("n")))
    rows = sound.select("file_id", column, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    rows = rows.select("file_id", F.substring(F.col(column), 5 + ENTRY_BYTES * F.col("k"), F.lit(ENTRY_BYTES)).alias("e"))
    return rows.select("file_id", *(little_endian(F.col("e"), at, size).alias(name) for name, (at, size) in ENTRY.items()))


def payloads(parts: DataFrame) -> DataFrame:
    """Index entries with payload and sound (the checksum holds). Payloads are cut where the file lies; no row but the file's carries all of it."""
    n = little_endian(F.col("index"), 0, 4)
    sound = parts.where(F.length("index") >= 4).withColumn("n", n).where((F.col("n") > 0) & (F.length("index") == 4 + ENTRY_BYTES * F.col("n")))

    def entry(k: Column) -> Column:
        own = F.substring(F.col("index"), 5 + ENTRY_BYTES * k, F.lit(ENTRY_BYTES))
        at = {name: little_endian(own, first, size) for name, (first, size) in ENTRY.items()}
        payload = section(F.col("content"), F.try_add(F.col("tile_data_offset"), at["offset"]), at["size"])
        return F.struct(*(value.alias(name) for name, value in at.items()), payload.alias("payload"))

    entries = sound.select("file_id", F.explode(F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), entry)).alias("e")).select("file_id", "e.*")
    return entries.withColumn("sound", (F.length("payload") == F.col("size")) & (F.crc32("payload") == F.col("checksum")))


METADATA = "width long, height long, tile_size long, max_zoom_level int, version long, vector_codec string, raster_codec string, source_hash string, custom map<string,string>, error string"


def parse_metadata(parts: DataFrame) -> DataFrame:
    """file_id and the metadata of each file; damage gives an error instead."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        names = ["file_id", "width", "height", "tile_size", "max_zoom_level", "version", "vector_codec", "raster_codec", "source_hash", "custom", "error"]
        for batch in batches:
            rows = []
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    m = codecs.from_cbor(data)
                    rows.append((file_id, m["width"], m["height"], m["tile_size"], m["max_zoom_level"], m["version"], tag(m["compression"]["vector_compression"]), tag(m["compression"]["raster_compression"]), m["source_hash"], list(m["custom"].items()), None))
                except (ValueError, KeyError, TypeError) as e:
                    rows.append((file_id, *[None] * 9, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    return parts.select(F.col("file_id").cast("long"), "metadata").mapInArrow(read, "file_id long, " + METADATA)


VECTORS = "file_id long, layer_id long, name string, opacity double, blend_mode string, path_id long, fill array<double>, seq long, kind string, x double, y double"
VECTOR_ROWS = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.string(), pa.float64(), pa.float64()]
VECTOR_NAMES = ["file_id", "layer_id", "name", "opacity", "blend_mode", "path_id", "fill", "seq", "kind", "x", "y"]
#: The same with control points (``x1, y1`` of a quadratic curve, both pairs of a cubic one) and strokes.
CURVES = VECTORS + ", x1 double, y1 double, x2 double, y2 double, stroke array<double>, stroke_width double"
CURVE_ROWS = [*VECTOR_ROWS, *[pa.float64()] * 4, pa.list_(pa.float64()), pa.float64()]
CURVE_NAMES = [*VECTOR_NAMES, "x1", "y1", "x2", "y2", "stroke", "stroke_width"]
#: Names of path commands in a file, and here; the control points that they have.
COMMANDS = {"MoveTo": "move", "LineTo": "line", "QuadraticTo": "quadratic", "CubicTo": "cubic", "Close": "close"}
CONTROLS = {"quadratic": ("x1", "y1"), "cubic": ("x1", "y1", "x2", "y2")}


def parse_vectors(parts: DataFrame) -> DataFrame:
    """file_id, layers, error: the number of layers in each vector section (raw deflate, then CBOR); empty sections have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layers, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    layers.append(len(codecs.from_cbor(codecs.inflate(data))["layers"]) if data else 0)
                    errors.append(None)
                except (ValueError, KeyError, TypeError, zlib.error) as e:
                    layers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(layers, pa.int64()), pa.array(errors, pa.string())], ["file_id", "layers", "error"])

    return parts.select(F.col("file_id").cast("long"), "vectors").mapInArrow(read, "file_id long, layers long, error string")


def commands_of(vectors: dict) -> Iterator[tuple]:
    """Rows of ``CURVES`` but for the file: one per path command, those of a layer without paths with nulls. A path without commands has none."""
    for layer_id, layer in enumerate(vectors["layers"]):
        own = (layer_id, layer["name"], float(layer["opacity"]), tag(layer["blend_mode"]).lower())
        if not layer["paths"]:
            yield *own, *[None] * 12
        for path_id, path in enumerate(layer["paths"]):
            fill, stroke = ([float(v) for v in path.get(c) or []] for c in ("fill", "stroke"))
            look = (stroke or None, float(path.get("stroke_width") or 0.0))
            for seq, command in enumerate(path["commands"]):
                name, at = (command, {}) if isinstance(command, str) else next(iter(command.items()))
                kind = COMMANDS[name]
                controls = (at.get(c) if c in CONTROLS.get(kind, ()) else None for c in ("x1", "y1", "x2", "y2"))
                yield *own, path_id, fill, seq, kind, *map(number, (at.get("x"), at.get("y"), *controls)), *look


def number(value) -> float | None:
    return None if value is None else float(value)


def parse_paths(parts: DataFrame) -> DataFrame:
    """``CURVES``: the path commands of the vector sections; damaged sections, which :func:`parse_vectors` tells, have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(file_id, *row) for row in (commands_of(codecs.from_cbor(codecs.inflate(data))) if data else ())]
                except (ValueError, KeyError, TypeError, AttributeError, zlib.error):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(CURVE_ROWS), CURVE_ROWS)], CURVE_NAMES)

    return parts.select(F.col("file_id").cast("long"), "vectors").mapInArrow(read, CURVES)


def vector_violations(paths: DataFrame) -> DataFrame:
    """file_id, layer_id, path_id, code: layers whose opacity is not from 0 to 1, paths that do not begin with a move, go on behind their end, or have points, control points of curves included, that are no finite numbers."""
    paths = paths.withColumns({c: F.lit(None).cast("double") for c in ("x1", "y1", "x2", "y2") if c not in paths.columns})
    layers = paths.groupBy("file_id", "layer_id").agg(F.first("opacity").alias("o")).where("not (o >= 0 and o <= 1)").select("file_id", "layer_id", F.lit(None).cast("long").alias("path_id"), F.lit("opacity").alias("code"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    lost = lambda *names: ~reduce(and_, map(finite, names))
    odd = (F.col("kind") != "close") & lost("x", "y") | reduce(or_, ((F.col("kind") == kind) & lost(*names) for kind, names in CONTROLS.items()))
    per = paths.where("path_id is not null").groupBy("file_id", "layer_id", "path_id")
    own = per.agg(F.min_by("kind", "seq").alias("first"), F.bool_or(odd).alias("odd"), F.min(F.when(F.col("kind") == "close", F.col("seq"))).alias("closed"), F.max("seq").alias("last"))
    code = F.when(F.col("first") != "move", "no_move").when(F.col("odd"), "coordinate").when(F.col("closed") < F.col("last"), "after_close")
    return layers.unionByName(own.withColumn("code", code).where("code is not null").select("file_id", "layer_id", "path_id", "code"))


def vector_section(rows: list[dict]) -> bytes:
    """The vector section of one file from its rows of ``VECTORS`` or ``CURVES``. Bounds hold the control points too, and so the whole curve."""
    shown = {short: name for name, short in COMMANDS.items()}
    layers: dict[int, dict] = {}
    box = lambda xs, ys: {"x": min(xs, default=0.0), "y": min(ys, default=0.0), "width": max(xs, default=0.0) - min(xs, default=0.0), "height": max(ys, default=0.0) - min(ys, default=0.0)}
    for r in sorted(rows, key=lambda r: (r["layer_id"], -1 if r["path_id"] is None else r["path_id"], r["seq"] or 0)):
        layer = layers.setdefault(r["layer_id"], {"id": r["name"], "name": r["name"], "paths": {}, "opacity": r["opacity"], "blend_mode": r["blend_mode"].capitalize()})
        if r["path_id"] is None:
            continue
        path = layer["paths"].setdefault(r["path_id"], {"commands": [], "fill": r["fill"] or None, "stroke": r.get("stroke") or None, "stroke_width": r.get("stroke_width") or 0.0, "xs": [], "ys": []})
        held = {c: r.get(c) for c in (*CONTROLS.get(r["kind"], ()), "x", "y")}
        path["commands"].append("Close" if r["kind"] == "close" else {shown[r["kind"]]: held})
        if r["kind"] != "close":
            path["xs"] += [v for c, v in held.items() if c[0] == "x" and v is not None]
            path["ys"] += [v for c, v in held.items() if c[0] == "y" and v is not None]
    every = [p for layer in layers.values() for p in layer["paths"].values()]
    whole = box([x for p in every for x in p["xs"]], [y for p in every for y in p["ys"]])
    for layer in layers.values():
        paths = list(layer["paths"].values())
        layer["bounds"] = box([x for p in paths for x in p["xs"]], [y for p in paths for y in p["ys"]])
        layer["paths"] = [{**{k: v for k, v in p.items() if k not in ("xs", "ys")}, "bounds": box(p["xs"], p["ys"])} for p in paths]
    return codecs.deflate(codecs.to_cbor({"layers": list(layers.values()), "bounds": whole}))


def tag(value) -> str:
    """The name of a tagged value: a text, or the only key of a map."""
    return value if isinstance(value, str) else next(iter(value))


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """file_id, level, x, y, width, height, rgba, error for PNG payloads (column ``payload``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(4).to_pylist():
                try:
                    image = codecs.from_png(data or b"")
                    out.append((image.shape[1], image.shape[0], image.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            columns = zip(*out) if out else [()] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], ["file_id", "level", "x", "y", "width", "height", "rgba", "error"])

    keys = [F.col(c).cast("long").alias(c) for c in ("file_id", "level", "x", "y")]
    return tiles.select(*keys, "payload").mapInArrow(read, "file_id long, level long, x long, y long, width int, height int, rgba binary, error string")


#: Pixels that a batch of rows holds, or one tile.
PIXELS_AT_ONCE = 1 << 18


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """file_id, level, x, y, r, g, b, a: the pixels of decoded tiles (file_id, level, x, y, width, height, rgba, tile_size) at their places in the level.

    Without a column level it is 0.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                held.append(row)
                size += row[4] * row[5]
                if size > PIXELS_AT_ONCE:
                    yield placed(held)
                    held, size = [], 0
        yield placed(held)

    def placed(held: list[tuple]) -> pa.RecordBatch:
        columns: list[list] = [[np.empty(0, np.int64)] for _ in range(4)]
        cells = [np.empty((0, 4), np.uint8)]
        for file_id, level, x, y, width, height, data, side in held:
            k = np.arange(width * height)
            for column, values in zip(columns, (np.full(len(k), file_id), np.full(len(k), level), x * side + k % width, y * side + k // width)):
                column.append(values)
            cells.append(np.frombuffer(data, dtype=np.uint8).reshape(-1, 4))
        colours = np.concatenate(cells).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in columns), *(pa.array(colours[:, c]) for c in range(4))], ["file_id", "level", "x", "y", *"rgba"])

    level = F.col("level") if "level" in tiles.columns else F.lit(0)
    keys = [F.col("file_id").cast("long"), level.cast("long").alias("level"), F.col("x").cast("long"), F.col("y").cast("long")]
    sizes = [F.col(c).cast("long").alias(c) for c in ("width", "height")]
    return tiles.select(*keys, *sizes, "rgba", F.col("tile_size").cast("long")).mapInArrow(spread, "file_id long, level long, x long, y long, r int, g int, b int, a int")


def encode_tiles(tiles: DataFrame, quality: int | None = None) -> DataFrame:
    """file_id, level, x, y, payload, uncompressed_size for RGBA tiles (width, height, rgba): PNG, or with ``quality`` (1 to 100) JPEG, which leaves transparency out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = codecs.to_png if quality is None else lambda image: jpeg.to_jpeg(image, quality)
            body = [turned(np.frombuffer(data, dtype=np.uint8).reshape(h, w, 4)) for w, h, data in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            sizes = [len(x) for x in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(body, pa.binary()), pa.array(sizes, pa.int64())], ["file_id", "level", "x", "y", "payload", "uncompressed_size"])

    keys = [F.col(c).cast("long").alias(c) for c in ("file_id", "level", "x", "y")]
    return tiles.select(*keys, "width", "height", "rgba").mapInArrow(write, "file_id long, level long, x long, y long, payload binary, uncompressed_size long")


def metadata_bytes(width: int, height: int, tile_size: int, zoom: int, custom: dict[str, str], source_hash: str, tiles: int, created_at: int = 0, layers: int = 0, quality: int | None = None) -> bytes:
    return codecs.to_cbor({
        "version": VERSION, "width": width, "height": height, "color_space": "Srgb", "tile_size": tile_size, "max_zoom_level": zoom, "vector_regions": layers, "raster_tiles": tiles,
        "compression": {"vector_compression": {"Flate2": {"level": 6}}, "raster_compression": "Png" if quality is None else {"Jpeg": {"quality": quality}}}, "segmentation": "Auto", "created_at": created_at, "source_hash": source_hash,
        "custom": custom, "encoder": {"name": "tilewright", "version": "1", "settings": {}},
    })


def write_files(tiles: DataFrame, meta: DataFrame, vectors: DataFrame | None = None, quality: int | None = None) -> DataFrame:
    """file_id, content: whole files from encoded tiles, metadata (file_id, width, height, tile_size, max_zoom_level) and path commands (``VECTORS``).

    One file is put together in one task, as it has to be one value; payloads stand in the order of their offsets.
    Files of metadata without tiles have an empty index. ``quality`` is that of the tiles, if they are JPEG.
    """

    def build(part: pa.Table, paths: pa.Table) -> pa.Table:
        held = part.to_pylist()
        if not held:
            return pa.table({"file_id": pa.array([], pa.int64()), "content": pa.array([], pa.binary())})
        rows = sorted((r for r in held if r["payload"] is not None), key=lambda r: (r["level"], r["y"], r["x"]))
        first, index, data = held[0], [], bytearray()
        for r in rows:
            index.append(struct.pack("<BIIQIII", r["level"], r["x"], r["y"], len(data), len(r["payload"]), r["uncompressed_size"], zlib.crc32(r["payload"])))
            data += r["payload"]
        drawn = paths.to_pylist()
        head = metadata_bytes(first["width"], first["height"], first["tile_size"], first["max_zoom_level"], {}, f"{zlib.crc32(data):08x}", len(rows), layers=len({r["layer_id"] for r in drawn}), quality=quality)
        vectors = vector_section(drawn)
        packed = struct.pack("<I", len(index)) + b"".join(index)
        at_vectors = HEADER_BYTES + len(head)
        at_index = at_vectors + len(vectors)
        at_data = at_index + len(packed)
        header = bytes.fromhex(MAGIC_HEX) + struct.pack("<IIQIQIQIQQ", VERSION, HEADER_BYTES, HEADER_BYTES, len(head), at_vectors, len(vectors), at_index, len(packed), at_data, at_data + len(data))
        return pa.table({"file_id": pa.array([first["file_id"]], pa.int64()), "content": pa.array([header + head + vectors + packed + bytes(data)], pa.binary())})

    if vectors is None:
        vectors = meta.sparkSession.createDataFrame([], VECTORS)
    return meta.join(tiles, "file_id", "left").groupBy("file_id").cogroup(vectors.groupBy("file_id")).applyInArrow(build, "file_id long, content binary")


def tile_paths(tiles: DataFrame, folder_of_file: bool = False) -> DataFrame:
    """Adds path: level_L/tile_X_Y.png, in a folder of the file's id where there are several files."""
    own = F.concat(F.lit("level_"), F.col("level").cast("string"), F.lit("/tile_"), F.col("x").cast("string"), F.lit("_"), F.col("y").cast("string"), F.lit(".png"))
    return tiles.withColumn("path", F.concat(F.lit("file_"), F.col("file_id").cast("string"), F.lit("/"), own) if folder_of_file else own)


def write_tiles(tiles: DataFrame, folder: str, folder_of_file: bool = False) -> DataFrame:
    """Writes each tile's payload (file_id, level, x, y, payload) to its :func:`tile_paths` in a folder; returns level, tiles. Tasks write side by side.

    A task may run again, or twice at once: a file is written whole under a name of its own first.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            levels = batch.column(0).to_pylist()
            for path, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                where, name = f"{root}/{path}".rsplit("/", 1)
                store.create_dir(where, recursive=True)
                part = f"{where}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(payload)
                store.move(part, f"{where}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int64())], ["level"])

    named = tile_paths(tiles, folder_of_file).select(F.col("level").cast("long"), "path", "payload")
    return named.mapInArrow(put, "level long").groupBy("level").agg(F.count("*").alias("tiles"))


def write_whole(files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes ``content`` under the name in a column, which may begin with folders, to a folder, as :func:`write_tiles` does; returns the names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        known = {root}
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                where, own = f"{root}/{path}".rsplit("/", 1)
                if where not in known:
                    store.create_dir(where, recursive=True)
                    known.add(where)
                part = f"{where}/.{own}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content.as_py())
                store.move(part, f"{where}/{own}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return files.select(F.col(name).alias("name"), "content").mapInArrow(put, "name string")
