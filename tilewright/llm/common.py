"""Helpers that several operators share: words, hashes, scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What every word count and word split here means, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, a local session) a temporary folder takes its place.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tilewright-')}")
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def quoted(names: list[str]) -> list[str]:
    """Names of columns as Spark takes them literally, dots and backticks included."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that its lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a worker has freed to the system: a worker goes on to other stages, and keeps its largest size otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def split_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered, as UTF-8."""
    return as_bytes(text).lower().split()


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in a row, numbers of words of each): as of :func:`split_words`, nulls have none."""
    words, which, counts = numbered_words(texts)
    known = hashes_of(words)
    return known[which] if len(known) else known, counts


def numbered_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(different words, the place there of each word of all texts in a row, numbers of words of each text).

    Arrow lowers, splits and numbers the words, so each different word of the texts is looked at once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves empty words
    coded = flat.dictionary_encode()
    ends = np.append(0, np.cumsum(there))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[there], np.diff(ends)


def hashes_of(words: pa.StringArray) -> np.ndarray:
    """xxHash of each string, in 64 bits."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    body = data.to_pybytes() if data else b""
    return np.fromiter(map(xxhash.xxh64_intdigest, map(body.__getitem__, map(slice, at, at[1:]))), dtype=np.uint64, count=len(words))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter, none if empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = combine(out, hashes[k : n - width + 1 + k])
    return np.unique(out)


def scatter(bucket: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows (bucket, one binary per array) that hold the elements of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    held, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    columns = [[x[order[i:j]].tobytes() for i, j in zip(starts, ends)] for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", *names])


def gather(part: pa.Table, name: str, dtype) -> np.ndarray:
    """All elements of a binary column that :func:`scatter` made."""
    out = []
    for chunk in part.column(name).chunks:
        wide = pa.types.is_large_binary(chunk.type)
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and offsets[-1] > offsets[0]:
            out.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(out).view(dtype) if out else np.empty(0, dtype)


def volume(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n, size or 0


def power_of_two(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(x, 1))))


def spread_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique, on columns without nulls.

    ``right`` is written first: both sides of the join then are plain shuffles (or ``right`` is broadcast where its measured
    size allows), and adaptive execution splits the partitions of ``left`` that hot keys make large.
    """
    return left.join(written(right, "join"), key)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component) with the smallest node of each.

    Alternating large-star and small-star steps until nothing changes. A step is one grouped minimum and one join over
    the edges, each a table in the shared folder, so plans stay small and lost executors cost a step; steps grow with
    the logarithm of the longest path. The edges of hubs are not gathered: their minimum goes to where they are. Nodes without an edge
    are not in the result.
    """

    def star(e: DataFrame, large: bool) -> tuple[DataFrame, tuple]:
        if large:
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        out = spread_join(both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), ["a"])
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return watched(out.where("a <> b").distinct())

    def watched(e: DataFrame) -> tuple[DataFrame, tuple]:
        """(``e`` as a table, its number of rows and a sum of their hashes)."""
        seen = Observation()
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        out = written(e.observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark")), name)
        return out, (seen.get["n"], seen.get["mark"])

    now, before = watched(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not before[0]:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    while True:
        now, after = star(star(now, True)[0], False)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def batches_of(texts: Iterable, most: int):
    """Consecutive lists of rows whose texts have about ``most`` bytes together."""
    block, size = [], 0
    for row, text in texts:
        block.append((row, text))
        size += len(text) + 1
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block
