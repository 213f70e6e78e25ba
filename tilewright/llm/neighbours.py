"""Nearest neighbours by cross-polytope hashing.

A table hashes a vector to the signed axis nearest to its pseudo-rotated direction: three rounds of random
signs and a fast Hadamard transform. Further rotations, the last one narrower, split these cells, so that their
number grows with the table and a cell holds about ``CELL_ROWS`` vectors. Vectors are scaled to the largest length and get one
more component that fills them up to it, so the largest inner product is the nearest direction. Every vector is
kept in one cell of each table; a query asks the cells whose axes are nearest to it, and what it finds there is
ranked by exact inner products in double precision.

How many cells a query asks is fitted: the true neighbours of at most ``SAMPLE`` queries are found by comparing
those with every vector, and the smallest number of cells that holds ``TARGET`` of them is taken. Vectors that
stand in clusters need few cells; directions without structure need many. Where ``MOST_PROBES`` do not do, wider
cells are tried, in the end those of one rotation, of which all may be asked.

Cells are dealt by their hashes into buckets, so a query travels once for all cells of a bucket. Equal vectors
are indexed once, with the smallest ids that a result can show. Buckets are split in slices of bounded size, so a
frequent direction does not gather in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix

TABLES = 12
CELL_ROWS, MOST_PROBES = 24, 2048
#: Queries whose true neighbours the number of cells is fitted on, and the share of these to be found.
SAMPLE, TARGET = 200, 0.96
SLICE_ROWS = 4000
SEED = 11


def signs(tables: int, rotations: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, rotations, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the columns of ``x`` (a power of two long), without scaling; ``x`` is overwritten."""
    width, n = x.shape
    step = 1
    while step < width:
        halves = x.reshape(width // (2 * step), 2, step, n)
        low, high = halves[:, 0], halves[:, 1]
        low += high  # a + b
        high *= -2
        high += low  # a - b
        step *= 2
    return x


def rotated(vectors: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Rows rotated, some at a time so that they stay in the processor's cache. Single precision: only nearness to axes is read from it."""
    out = np.empty(vectors.shape, dtype=np.float32)
    for i in range(0, len(vectors), 512):
        part = np.ascontiguousarray(vectors[i : i + 512].T, dtype=np.float32)
        for flips in rounds:
            part *= flips.astype(np.float32)[:, None]
            part = hadamard(part)
        out[i : i + 512] = part.T
    return out


def splits(n: int, width: int, cell_rows: int) -> list[int]:
    """How many signed axes each rotation has, so that ``n`` vectors lie about ``cell_rows`` in a cell."""
    out = [2 * width]
    while (rest := n / (math.prod(out) * cell_rows)) >= 2:
        out.append(min(2 * width, 1 << int(math.log2(rest))))
    return out


def axes(vectors: np.ndarray, rounds: np.ndarray, count: int) -> np.ndarray:
    """How near each row is to the first ``count`` signed axes of a rotation."""
    turned = rotated(vectors, rounds)[:, : count // 2]
    return np.concatenate((turned, -turned), axis=1)


def cells(vectors: np.ndarray, rounds: np.ndarray, counts: list[int]) -> np.ndarray:
    """The cell of each row: its nearest axis in every rotation."""
    code = np.zeros(len(vectors), dtype=np.int64)
    for flips, count in zip(rounds, counts):
        code = code * count + axes(vectors, flips, count).argmax(axis=1)
    return code


def nearest_cells(vectors: np.ndarray, rounds: np.ndarray, counts: list[int], most: int) -> np.ndarray:
    """For each row its ``most`` nearest cells, nearest first: those whose axes lack least to the nearest ones, in squares."""
    far, codes = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), dtype=np.int64)
    for flips, count in zip(rounds, counts):
        near = axes(vectors, flips, count)
        lack = (near.max(axis=1, keepdims=True) - near) ** 2
        order = np.argsort(lack, axis=1, kind="stable")
        lack = np.take_along_axis(lack, order, axis=1)
        # Of two sorted lists the sum at places r and i has (r + 1) * (i + 1) - 1 others before it.
        r, i = np.arange(far.shape[1]), np.arange(count)
        r, i = np.nonzero((r[:, None] + 1) * (i + 1) <= most)
        far, codes = far[:, r] + lack[:, i], codes[:, r] * count + order[:, i]
        if far.shape[1] > most:
            best = np.argpartition(far, most - 1, axis=1)[:, :most]
            far, codes = np.take_along_axis(far, best, axis=1), np.take_along_axis(codes, best, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        far, codes = np.take_along_axis(far, order, axis=1), np.take_along_axis(codes, order, axis=1)
    return codes


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v: array of double) without null, zero and unfinished vectors."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


EMPTY = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, target: float = TARGET, slice_rows: int = SLICE_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of every row whose id is divisible by ``every``.

    Rows (vec_id, embedding). Nulls, zero vectors and those with null or non-finite components take no part.
    Vectors have inner products with those of their own length only: each length is searched by itself. An empty
    table gives no rows. Rows that share an id are one candidate each. Other columns are ignored.
    """
    rows = usable(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")))
    # Largest components first: squares of what is scaled by them stay finite.
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    out = None
    for size in sizes.orderBy("dims").collect():  # a row per length of vectors
        part = nearest_of(rows.where(F.size("v") == size["dims"]), size["dims"], size["n"], size["top"], k, every, tables, target, slice_rows, cell_rows)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], EMPTY) if out is None else out


def true_neighbours(rows: DataFrame, dims: int, k: int, every: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, which of them, a true neighbour of it): of at most ``most`` queries, by comparing them with all rows."""
    chosen = rows.where(F.col("vec_id") % every == 0).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    queries = np.array([r["v"] for r in chosen], dtype=np.float64).reshape(-1, dims)
    if not len(queries):
        return queries, np.empty(0, dtype=np.int64), np.empty((0, dims))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scores = np.empty((0, dims)), np.empty((len(queries), 0))
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                held = np.concatenate((held, matrix(batch.column(0).slice(i, 4000), dims)))
                scores = np.concatenate((scores, queries @ held[scores.shape[1] :].T), axis=1)
                if scores.shape[1] > k:
                    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    at, back = np.unique(best, return_inverse=True)
                    kept = np.full((len(queries), len(at)), -np.inf)
                    np.put_along_axis(kept, back.reshape(best.shape), np.take_along_axis(scores, best, axis=1), axis=1)
                    held, scores = held[at], kept
        which, near = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(scores[which, near]), pa.array(list(held[near]), pa.list_(pa.float64()))], ["q", "score", "v"])

    found = rows.select("v").distinct().mapInArrow(compare, "q long, score double, v array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    # The nearest one is mostly the query itself, which any number of cells finds.
    best = found.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k)).select("q", "v").collect()  # most x k rows
    return queries, np.array([r["q"] for r in best], dtype=np.int64), np.array([r["v"] for r in best], dtype=np.float64).reshape(-1, dims)


def nearest_of(rows: DataFrame, dims: int, n: int, top: float, k: int, every: int, tables: int, target: float, slice_rows: int, cell_rows: int) -> DataFrame:
    """:func:`nearest` of vectors of one length, of which there are ``n`` with components up to ``top``."""
    rows = rows.withColumn("code", F.xxhash64("v"))
    largest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))))).first()[0]
    width = 1 << (dims).bit_length()  # more than dims, for the component that fills up

    def widened(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), width))
        out[:, :dims] = v / top / largest
        return out

    def filled(v: np.ndarray) -> np.ndarray:
        out = widened(v)
        out[:, dims] = np.sqrt(np.maximum(0, 1 - (out**2).sum(axis=1)))
        return out

    sample, which, near = true_neighbours(rows, dims, k, every, SAMPLE)
    counts = splits(n, width, cell_rows)
    while True:
        rounds, total = signs(tables, len(counts), width, SEED), math.prod(counts)
        most = min(total, MOST_PROBES) if len(counts) > 1 else total
        asked_first = np.full(len(which), most + 1)  # after how many cells a query reaches its neighbour in any table
        for t in range(tables if len(which) else 0):
            own = cells(filled(near), rounds[t], counts)
            for q in range(len(sample)):
                mine = np.flatnonzero(which == q)
                codes = nearest_cells(widened(sample[q : q + 1]), rounds[t], counts, most)[0]
                order = np.argsort(codes)
                at = np.minimum(np.searchsorted(codes, own[mine], sorter=order), len(codes) - 1)
                asked_first[mine] = np.minimum(asked_first[mine], np.where(codes[order[at]] == own[mine], order[at] + 1, most + 1))
        probes = int(np.quantile(asked_first, target, method="higher")) if len(which) else most
        if probes <= most:
            break
        counts.pop()
    buckets = max(1, -(-n // slice_rows))

    def bucket_of(codes: np.ndarray, table: int) -> np.ndarray:
        return (mix(codes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64) + table * buckets

    # A result shows at most k of a vector's ids, and the query's own is left out.
    order = Window.partitionBy("code", "v").orderBy("vec_id")
    ids = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    distinct = ids.groupBy("code", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = asking.groupBy("code", "v").agg(F.min("vec_id").alias("query"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = filled(matrix(batch.column(0), dims))
            for t in range(tables):
                cell = cells(full, rounds[t], counts)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(cell, t)), pa.array(cell), batch.column(0), batch.column(1)], ["bucket", "cell", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                v = widened(matrix(part.column(0), dims))
                for t in range(tables):
                    near = nearest_cells(v, rounds[t], counts, probes)
                    at, cell = np.repeat(np.arange(len(v)), near.shape[1]), near.ravel()
                    bucket = bucket_of(cell, t)
                    order = np.lexsort((cell, bucket, at))
                    at, cell, bucket = at[order], cell[order], bucket[order]
                    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(cell))
                    own = pa.array(at[new])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), lists, part.column(1).take(own), part.column(0).take(own)], ["bucket", "cells", "query", "q"])

    held = distinct.select("v", "ids").mapInArrow(index, "bucket long, cell long, v array<double>, ids array<long>")
    slices = held.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * slice_rows)).cast("int").alias("slices"))
    held = held.join(slices, "bucket").withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int")).drop("slices")
    asked = queries.select("v", "query").mapInArrow(ask, "bucket long, cells array<long>, query long, q array<double>")
    asked = asked.join(slices, "bucket").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("slice", pa.int32()), ("found", pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))])
        if not len(left) or not len(right):
            return schema.empty_table()
        cell = left.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, base = cell[order], matrix(left.column("v").combine_chunks(), dims)[order]
        ids = left.column("ids").combine_chunks().take(pa.array(order))
        starts, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        asked, lists = matrix(right.column("q").combine_chunks(), dims), right.column("cells").combine_chunks()
        wanted = lists.flatten().to_numpy()
        by = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(wanted, kind="stable")
        wanted, by = wanted[order], by[order]
        there, first = np.unique(cell, return_index=True)
        last = np.append(first[1:], len(cell))
        low, high = np.searchsorted(wanted, there, side="left"), np.searchsorted(wanted, there, side="right")
        best = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        new, size = [], 0

        def cut(parts: list[tuple]) -> tuple:
            """Of each query the k + 1 best rows, and those as good as the last of them."""
            q, row, score = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((-score, q))
            q, row, score = q[order], row[order], score[order]
            begin = np.searchsorted(q, q, side="left")
            bar = score[np.minimum(begin + k, np.searchsorted(q, q, side="right") - 1)]
            fine = score >= bar
            return q[fine], row[fine], score[fine]

        for c in np.flatnonzero(high > low):
            for i in range(low[c], high[c], 256):
                q, row = by[i : min(i + 256, high[c])], np.arange(first[c], last[c])
                score = np.einsum("qd,nd->qn", asked[q], base[row])
                new.append((np.repeat(q, len(row)), np.tile(row, len(q)), score.ravel()))
                size += score.size
                if size > 2_000_000:
                    best, new, size = cut([best, *new]), [], 0
        q, row, score = cut([best, *new])
        copies = np.diff(starts)[row]
        ends = np.cumsum(copies)
        near = flat[np.arange(int(copies.sum())) + np.repeat(starts[row] - (ends - copies), copies)]
        q, score = np.repeat(q, copies), np.repeat(score, copies)
        order = np.lexsort((near, -score, q))
        q, near, score = q[order], near[order], score[order]
        begin = np.searchsorted(q, q, side="left")
        fine = np.arange(len(q)) - begin <= k
        q, near, score = q[fine], near[fine], score[fine]
        pairs = pa.StructArray.from_arrays([pa.array(-score), pa.array(near)], ["far", "vec_id"])
        held, first = np.unique(q, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(q)).astype(np.int32)), pairs)
        own = pa.array(held)
        return pa.table([right.column("query").combine_chunks().take(own), right.column("slice").combine_chunks().take(own), lists.cast(schema.field("found").type)], schema=schema)

    # One list of at most k + 1 for each query, bucket and slice; a query has at most tables x probes lists of a slice.
    # A vector is in one cell of a table, so it comes once for each table at most.
    partial = held.groupBy("bucket", "slice").cogroup(asked.groupBy("bucket", "slice")).applyInArrow(rank, "query long, slice int, found array<struct<far: double, vec_id: long>>")
    gathered = partial.groupBy("query", "slice").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, (k + 1) * tables).alias("best"))
    best = gathered.select("query", F.explode("best").alias("f")).select("query", "f.far", "f.vec_id").distinct()
    rows_of = asking.join(queries, ["code", "v"]).select(F.col("vec_id").alias("query_id"), "query")
    out = rows_of.join(best, "query").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("far", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("far")).alias("score"))
