"""Containers as a Spark data source that reads ranges: header and index of a file, then only the tiles that are asked for.

``spark.read.format("tiled_container").load(folder)`` gives a row per index entry, and one with an ``error`` for each damaged file.
Conditions on level, x and y are pushed down: payloads of other tiles are not read. Large files are split by where payloads lie, small
ones are read several in a task; the driver only lists the folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .container import ENTRY_BYTES, HEADER_BYTES, MAGIC_HEX, VERSION

SCHEMA = "path string, level long, x long, y long, offset long, size long, uncompressed_size long, checksum long, payload binary, sound boolean, error string"
KINDS = [pa.string(), *[pa.int64()] * 7, pa.binary(), pa.bool_(), pa.string()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ENTRY = np.dtype([("level", "u1"), ("x", "<u4"), ("y", "<u4"), ("offset", "<u8"), ("size", "<u4"), ("uncompressed_size", "<u4"), ("checksum", "<u4")])
#: Bytes of files in a task; bytes between two tiles that are read over; bytes of one read; index entries at once.
RUN_BYTES, GAP_BYTES, READ_BYTES, ENTRIES_AT_ONCE = 64 << 20, 64 << 10, 8 << 20, 1 << 20
#: Columns that conditions are pushed down on.
PUSHED = ("level", "x", "y")


class Ranges:
    """A file of which ranges are read; ``read_bytes`` and ``reads`` count them."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.read_bytes, self.reads = read_at, size, 0, 0

    def get(self, at: int, n: int) -> bytes:
        """What the file has of ``n`` bytes at ``at``."""
        n = max(0, min(n, self.size - at))
        if not n:
            return b""
        self.reads += 1
        self.read_bytes += n
        return self.read_at(at, n)


def header_of(file: Ranges) -> tuple[str | None, dict[str, int]]:
    """(the first rule that the header breaks, as :func:`container.header_violation` names it; index and data places)."""
    data = file.get(0, HEADER_BYTES)
    if len(data) < HEADER_BYTES:
        return "short", {}
    if data[:4].hex() != MAGIC_HEX:
        return "magic", {}
    version, header, meta, meta_size, vectors, vector_size, index, index_size, tiles, _ = struct.unpack("<IIQIQIQIQQ", data[4:])
    if version > VERSION:
        return "version", {}
    if header != HEADER_BYTES:
        return "header_size", {}
    if meta < header or meta >= 1 << 63:
        return "metadata_offset", {}
    if max(meta + meta_size, vectors + vector_size, index + index_size) > file.size:
        return "section", {}
    return None, {"index": index, "index_size": index_size, "tiles": tiles}


def entries_of(file: Ranges, places: dict[str, int]) -> Iterator[np.ndarray]:
    """The index, some entries at a time. One whose length is not that of its count has none."""
    at, size = places["index"], places["index_size"]
    count = struct.unpack("<I", file.get(at, 4))[0] if size >= 4 else 0
    if size != 4 + ENTRY_BYTES * count:
        return
    for k in range(0, count, ENTRIES_AT_ONCE):
        n = min(ENTRIES_AT_ONCE, count - k)
        yield np.frombuffer(file.get(at + 4 + ENTRY_BYTES * k, ENTRY_BYTES * n), dtype=ENTRY)


def fits(entries: np.ndarray, conditions: list[tuple[str, str, object]]) -> np.ndarray:
    keep = np.ones(len(entries), dtype=bool)
    for column, how, value in conditions:
        own = entries[column].astype(np.int64)
        keep &= {"=": lambda: own == value, ">": lambda: own > value, ">=": lambda: own >= value, "<": lambda: own < value, "<=": lambda: own <= value, "in": lambda: np.isin(own, list(value))}[how]()  # noqa: B023
    return keep


def rows_of(path: str, entries: np.ndarray, payloads: list[bytes | None] | None) -> pa.RecordBatch:
    n = len(entries)
    numbers = [pa.array(entries[c].astype(np.int64), mask=entries[c] >= 1 << 63 if c == "offset" else None) for c in ENTRY.names]
    sound = [p is not None and len(p) == s and zlib.crc32(p) == c for p, s, c in zip(payloads, entries["size"].tolist(), entries["checksum"].tolist())] if payloads is not None else [None] * n
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *numbers, pa.array(payloads if payloads is not None else [None] * n, pa.binary()), pa.array(sound, pa.bool_()), pa.nulls(n, pa.string())], NAMES)


def tiles_of(file: Ranges, path: str, run: int = 0, runs: int = 1, conditions: list[tuple[str, str, object]] = (), with_payloads: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of one file: the entries that ``conditions`` leave and whose payloads begin in the ``run``-th of ``runs`` equal parts of the file.

    Payloads that lie next to each other are read at once.
    """
    wrong, places = header_of(file)
    if wrong:
        if run == 0 and not conditions:  # a damaged file has no level, so no condition holds
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([path, *[None] * 9, wrong], KINDS)], NAMES)
        return
    span = max(1, -(-file.size // runs))
    for entries in entries_of(file, places):
        start = entries["offset"] + np.uint64(places["tiles"])
        start = np.where(start < entries["offset"], np.uint64(file.size), start)  # beyond 64 bits: nowhere
        part = np.minimum(start // np.uint64(span), np.uint64(runs - 1))
        keep = fits(entries, conditions) & (part == np.uint64(run))
        entries, start = entries[keep], np.minimum(start[keep], np.uint64(file.size)).astype(np.int64)
        if not with_payloads:
            yield rows_of(path, entries, None)
            continue
        order = np.argsort(start, kind="stable")
        entries, start = entries[order], start[order]
        end = np.minimum(start + entries["size"].astype(np.int64), file.size)
        i = 0
        while i < len(entries):
            j, last = i + 1, end[i]
            while j < len(entries) and start[j] <= last + GAP_BYTES and max(last, end[j]) - start[i] <= READ_BYTES:
                last = max(last, end[j])
                j += 1
            data = file.get(int(start[i]), int(last - start[i]))
            payloads = [data[int(a - start[i]) : int(b - start[i])] for a, b in zip(start[i:j], end[i:j])]
            yield rows_of(path, entries[i:j], payloads)
            i = j


@dataclass
class Run(D.InputPartition):
    """(path, size, run, runs) of each file or part of a file that a task reads."""

    files: list[tuple[str, int, int, int]]


class TileReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("tiled_container needs a path")
        self.run_bytes = int(options.get("runbytes", RUN_BYTES))
        self.with_payloads = str(options.get("payloads", "true")).lower() == "true"
        self.conditions: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in"}
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column in PUSHED and type(f) in signs and f.value is not None:
                self.conditions.append((column, signs[type(f)], f.value))
            elif column in PUSHED and isinstance(f, D.IsNotNull):
                self.conditions.append((column, ">=", 0))
            else:
                yield f

    def partitions(self) -> list[Run]:
        """Small files together, large ones in parts, by their sizes alone."""
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        out, held, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f.base_name.startswith((".", "_")):
                continue
            runs = max(1, -(-f.size // self.run_bytes))
            if runs > 1:
                out += [Run([(f.path, f.size, run, runs)]) for run in range(runs)]
                continue
            held.append((f.path, f.size, 0, 1))
            size += f.size
            if size >= self.run_bytes:
                out.append(Run(held))
                held, size = [], 0
        if held:
            out.append(Run(held))
        return out or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        for path, size, run, runs in partition.files:
            with store.open_input_file(path) as f:
                file = Ranges(lambda at, n: f.read_at(n, at), size)  # noqa: B023
                yield from tiles_of(file, _shown(self.folder, path), run, runs, self.conditions, self.with_payloads)


def _store(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


def _shown(folder: str, path: str) -> str:
    """The path as Spark's file sources show it."""
    scheme = folder.split("://")[0] if "://" in folder else "file"
    return f"file:{path}" if scheme == "file" else f"{scheme}://{path}"


class ContainerTiles(D.DataSource):
    """Options: ``path`` (a folder or a file), ``runBytes`` (bytes of files in a task), ``payloads`` (false: the index only)."""

    @classmethod
    def name(cls) -> str:
        return "tiled_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def read_tiles(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """file_id (as :func:`container.read_files` gives it) and the rows of the data source, registered in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerTiles)
    tiles = spark.read.format(ContainerTiles.name()).options(**{k: str(v) for k, v in options.items()}).load(path)
    return tiles.select(F.xxhash64("path").alias("file_id"), "*")
