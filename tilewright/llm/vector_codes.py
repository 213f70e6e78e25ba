"""Short codes of vectors: one codebook a part, whose entries are found through a VA-file.

Components are whole numbers from the start (``floor(4096 * x)``), so every distance, tie and mean is exact and the
result does not depend on how rows are dealt. A codebook has 16 entries; each of its coordinates is quantised
into a cell of a few bits. A part looks up, for each coordinate and cell, the least and the largest squared distance
to it; sums of these bound the distance to every entry, and only entries whose lower bound is not above the
smallest upper one are refined by whole-number distances.

A round is one pass over the vectors: tasks assign parts and add up components by entry, Spark sums
16 x length numbers. The codebooks travel with the tasks: 16 vectors for each length of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell of the VA-file, and how far sums of doubles may be off.
CELL_BITS, SLACK = 3, 1e-9
BLOCK_ROWS = 4096


def largest(dims: int) -> int:
    """Whole numbers beyond this are held to it, so that sums of ``dims`` squared differences fit in 64 bits."""
    return isqrt((1 << 62) // max(dims, 1)) // 2


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)``, with zeros up to a multiple of 8 components."""
    n, dims = vectors.shape
    most = largest(dims)
    out = np.zeros((n, -(-dims // PARTS) * PARTS), dtype=np.int64)
    with np.errstate(over="ignore"):
        out[:, :dims] = np.clip(np.floor(vectors * SCALE), -most, most)
    return out


class CellFile:
    """The entries of a codebook, with their coordinates in cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        """``entries``: whole numbers, a row each. Cells hold equal numbers of entries and reach from the least to the largest of them."""
        self.entries = entries
        count, dims = entries.shape
        cells = min(1 << bits, count)
        ranks = np.empty_like(entries)
        np.put_along_axis(ranks, np.argsort(entries, axis=0, kind="stable"), np.arange(count)[:, None], axis=0)
        self.cells = ranks * cells // count
        self.low, self.high = np.empty((dims, cells)), np.empty((dims, cells))
        for c in range(cells):
            held = self.cells == c
            self.low[:, c] = np.where(held, entries, np.iinfo(np.int64).max).min(axis=0)
            self.high[:, c] = np.where(held, entries, np.iinfo(np.int64).min).max(axis=0)
        # Column e has a one for each cell of entry e: tables times this sum up what the entry's cells hold.
        self.chosen = np.zeros((dims * cells, count))
        for e in range(count):
            self.chosen[np.arange(dims) * cells + self.cells[e], e] = 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distance of each query to each entry."""
        q = queries[:, :, None].astype(np.float64)
        below, above = self.low - q, q - self.high
        near = np.maximum(np.maximum(below, above), 0) ** 2
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        return near.reshape(len(q), -1) @ self.chosen * (1 - SLACK), far.reshape(len(q), -1) @ self.chosen * (1 + SLACK)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, the lower of equal ones; squared distance) of each query."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        apart = queries[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (apart * apart).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(best)), best]


def assigned(files: list[CellFile], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance of each part) of rows of whole numbers."""
    cut = rows.reshape(len(rows), PARTS, -1)
    found = [files[p].nearest(cut[:, p]) for p in range(PARTS)]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def blocks(batches: Iterator[pa.RecordBatch], dims_at: int, ints_at: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows of one length of vectors, that length, their whole numbers)."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(i, BLOCK_ROWS)
            lengths = part.column(dims_at).to_numpy()
            for dims in np.unique(lengths).tolist():
                own = part.filter(pa.array(lengths == dims))
                data = b"".join(x.as_py() for x in own.column(ints_at))
                yield own, dims, np.frombuffer(data, dtype=np.int64).reshape(own.num_rows, -1)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, ints (whole numbers, little-endian 64 bits each) of the rows that take part."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                column = part.column(2)
                lengths = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
                there = column.is_valid().to_numpy(zero_copy_only=False)
                starts = np.append(0, np.cumsum(np.where(there, lengths, 0)))
                wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
                use = there & (wrong[starts[1:]] == wrong[starts[:-1]])
                ints = [b""] * part.num_rows
                for dims in np.unique(lengths[use]).tolist():
                    which = np.nonzero(use & (lengths == dims))[0]
                    rows = whole_numbers(flat[starts[which][:, None] + np.arange(dims)].reshape(len(which), dims))
                    for k, row in zip(which.tolist(), rows):
                        ints[k] = row.tobytes()
                keep = pa.array(use)
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (part.column(0), part.column(1), pa.array(lengths.astype(np.int32)), pa.array(ints, pa.binary()))], ["vec_id", "label", "dims", "ints"])

    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long"), label, F.col("embedding").cast("array<double>").alias("v"))
    return written(rows.mapInArrow(convert, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, dims int, ints binary"), "codes-vectors")


def first_codebooks(kept: DataFrame) -> dict[int, list[np.ndarray]]:
    """For each length the parts of the 16 rows with the smallest ids: entries x components, a matrix a part."""
    order = Window.partitionBy("dims").orderBy(F.col("vec_id").asc_nulls_last(), "ints")
    found = kept.select("dims", "vec_id", "ints").withColumn("n", F.row_number().over(order)).where(F.col("n") <= ENTRIES).collect()  # 16 rows a length
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in found:
        held.setdefault(r["dims"], []).append((r["n"], np.frombuffer(r["ints"], dtype=np.int64)))
    out = {}
    for dims, rows in held.items():
        whole = np.array([x for _, x in sorted(rows, key=lambda r: r[0])]).reshape(len(rows), PARTS, -1)
        out[dims] = [whole[:, p].copy() for p in range(PARTS)]
    return out


def learned(kept: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """The codebooks after ``rounds`` rounds over all rows."""
    books = first_codebooks(kept)

    def one_round(now: dict[int, list[np.ndarray]]) -> DataFrame:
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = {dims: [CellFile(b) for b in parts] for dims, parts in now.items()}
            sums = {dims: [np.zeros_like(b) for b in parts] for dims, parts in now.items()}
            counts = {dims: [np.zeros(len(b), dtype=np.int64) for b in parts] for dims, parts in now.items()}
            for _, dims, rows in blocks(batches, 0, 1):
                chosen, _ = assigned(files[dims], rows)
                cut = rows.reshape(len(rows), PARTS, -1)
                for p in range(PARTS):
                    np.add.at(sums[dims][p], chosen[:, p], cut[:, p])
                    counts[dims][p] += np.bincount(chosen[:, p], minlength=len(counts[dims][p]))
            for dims, parts in sums.items():
                for p, total in enumerate(parts):
                    used = np.nonzero(counts[dims][p])[0]
                    entry, place = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
                    n = len(entry)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, dims, np.int32), np.full(n, p, np.int32), entry.astype(np.int32), place.astype(np.int32), total[entry, place], counts[dims][p][entry])], ["dims", "part", "entry", "place", "total", "n"])

        return kept.select("dims", "ints").mapInArrow(add_up, "dims int, part int, entry int, place int, total long, n long")

    for _ in range(rounds if books else 0):
        summed = one_round(books).groupBy("dims", "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = {dims: [b.copy() for b in parts] for dims, parts in books.items()}
        for r in summed.collect():  # 16 x components for each length
            new[r["dims"]][r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = new
    return books


def digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in parts for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, codebooks_sha256 of each row that takes part; the codebooks by length of vectors).

    Rows (vec_id, embedding, and label if there is one). Vectors that are null or hold null or non-finite components are
    dropped. Vectors of different lengths have codebooks of their own; lengths that are no multiple of 8 are filled with zeros.
    Components beyond ``largest`` are held to it. Rows without an id come last among the first entries, rows that share one
    in the order of their numbers; each is a row of the result. No rows give none. Other columns are ignored.
    """
    kept = kept_vectors(vectors)
    books = learned(kept, rounds)
    named = {dims: digest(parts) for dims, parts in books.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {dims: [CellFile(b) for b in parts] for dims, parts in books.items()}
        for own, dims, rows in blocks(batches, 2, 3):
            chosen, apart = assigned(files[dims], rows)
            data = chosen.astype(np.uint8).tobytes()
            codes = [data[i : i + PARTS].hex() for i in range(0, len(data), PARTS)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(codes, pa.string()), pa.array(apart.sum(axis=1)), pa.array([named[dims]] * len(codes), pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"), books


def decode(codes: DataFrame, books: list[np.ndarray], name: str = "embedding") -> DataFrame:
    """``codes`` (with a column code) and the vectors that its codes stand for, by the codebooks of one length."""
    name = free_name(name, codes.columns)
    parts = [F.array(*(F.array(*(F.lit(x / SCALE) for x in entry)) for entry in b.tolist())) for b in books]
    held = [F.element_at(part, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, part in enumerate(parts)]
    return codes.withColumn(name, F.concat(*held))


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (``error`` over all rows with the label; nulls are one), codebooks_sha256."""
    coded = written(encode(vectors)[0], "codes-rows")
    coded = coded.select("vec_id", "code", "error", "codebooks_sha256", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    sums = coded.groupBy("no_label", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    out = spread_join(coded, sums, ["no_label", "label"])
    return out.select("vec_id", "code", "error", F.expr("try_cast(sum as long)").alias("label_error"), "codebooks_sha256")


def _sql() -> str:
    apart = "list_sum([(q[i] - c[i]) * (q[i] - c[i]) for i in range(1, len(q) + 1)])"
    rounds = "".join(
        f""",
near{r} AS MATERIALIZED (SELECT vec_id, label, p, q, min({{'d': {apart}::BIGINT, 'e': e}}) AS best FROM parts JOIN book{r} USING (p) GROUP BY ALL)"""
        + (
            ""
            if r == ROUNDS
            else f""",
sums{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, best.e AS e, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM near{r}) GROUP BY p, e, i),
mean{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{r} GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))"""
        )
        for r in range(ROUNDS + 1)
    )
    last = ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM parts QUALIFY e < {ENTRIES}){rounds},
rows AS (SELECT vec_id, label, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{last} GROUP BY vec_id, label),
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, named
"""


OP13_SQL = _sql()
