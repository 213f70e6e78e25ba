"""SuperMinHash near-duplicate detection: correlated ranks, bands, verification on full sets, components.

1. Every element of a set deals ranks 0, 1, 2, ... to the slots of the signature by a permutation of its own, each with
   a random fraction; a slot keeps the smallest rank plus fraction that it gets. As an element gives each rank to one
   slot only, the slots of a signature are negatively correlated and estimate similarity with less variance than
   independent ones. All elements of a block of sets deal one rank at a time, and a set is finished when no slot can
   become smaller any more: after about ``slots * ln(slots) / elements`` ranks, one or two for long texts.
2. A signature is cut in bands. Sets that agree in a band are candidates; tasks first join their own candidates to
   the smallest one of each band value, so that a value which many sets have is shuffled once a block.
3. Candidates that hang together are compared on their full sets, by the search of :mod:`jaccard`, which splits large
   groups; equal sets are one throughout.
4. Links make up the components (alternating stars in Spark).

Two sets with a similarity of eight tenths agree in none of 54 bands of 6 slots once in ten million times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import combine, components, gather, give_back, mix, power_of_two, scatter, volume, written

WORDS, PERCENT = 4, 80
BANDS, ROWS = 54, 6
#: Bits of the fraction that follows a rank, elements that deal ranks together, and bytes of band values a bucket and a block.
FRACTION_BITS, BLOCK_ELEMENTS, BUCKET_BYTES, BLOCK_CODES = 40, 1 << 14, 32 << 20, 1_000_000
_STEP = 0x9E3779B97F4A7C15


def deal(elements: np.ndarray, owner: np.ndarray, held: np.ndarray) -> None:
    """Let ``elements`` (distinct in a set) deal ranks to the signatures ``held`` (sets x slots) of their owners, in place."""
    slots = held.shape[1]
    flat = held.reshape(-1)
    places = np.tile(np.arange(slots, dtype=np.uint16 if slots < 1 << 16 else np.uint32), (len(elements), 1))
    rows = np.arange(len(elements))
    for rank in range(slots):
        draw = mix(elements[rows] + np.uint64((rank + 1) * _STEP & (1 << 64) - 1))
        # A step of a shuffle: the place at a random position from here on comes here.
        at = rank + ((draw >> np.uint64(FRACTION_BITS)) * np.uint64(slots - rank) >> np.uint64(64 - FRACTION_BITS)).astype(np.int64)
        slot = places[rows, at].astype(np.int64)
        places[rows, at] = places[rows, rank]
        value = np.uint64(rank << FRACTION_BITS) | (draw & np.uint64((1 << FRACTION_BITS) - 1))
        np.minimum.at(flat, owner[rows] * slots + slot, value)
        # What comes now is at least rank + 1: a set is finished if all its slots have less.
        rows = rows[(held.max(axis=1) >= np.uint64((rank + 1) << FRACTION_BITS))[owner[rows]]]
        if not len(rows):
            return


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets of 64-bit hashes; those of empty sets have the largest value throughout."""
    held = np.full((len(sets), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return held
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(0, len(elements), BLOCK_ELEMENTS):
        own = owner[i : i + BLOCK_ELEMENTS]
        deal(elements[i : i + BLOCK_ELEMENTS], own - own[0], held[own[0] : own[-1] + 1])
    return held


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard similarity of sets from their signatures."""
    return (left == right).mean(axis=-1)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of the bands of ``rows`` slots (sets x bands), each with its number."""
    parts = signature.reshape(len(signature), -1, rows)
    code = mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(_STEP)) + parts[:, :, 0]
    for k in range(1, rows):
        code = combine(code, parts[:, :, k])
    return code


def grouped(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, number: int = BANDS, rows: int = ROWS) -> DataFrame:
    """lo, group: sets that agree in a band are in one group; sets that agree with no other are in none. Rows (text)."""
    buckets = power_of_two(volume(docs)[0] * number * 16 / BUCKET_BYTES)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, nodes, size, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            code = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
            node = np.concatenate(nodes) if nodes else np.empty(0, dtype=np.int64)
            pairs, code, head = jaccard.heads(code, node)
            yield scatter((code & np.uint64(buckets - 1)).astype(np.int64), [code, head], ["code", "node"])
            yield scatter(np.full(len(pairs), -1), [pairs[:, 0].copy(), pairs[:, 1].copy()], ["code", "node"])

        for _, sets in jaccard.word_sets(batches, 0, width):
            new = {}
            for elements in sets:
                if len(elements) and (node := jaccard.node_of(elements)[1]) not in seen:
                    seen.add(node)
                    new[node] = elements
            if new:
                codes.append(bands(signatures(list(new.values()), number * rows), rows).ravel())
                nodes.append(np.repeat(np.array(list(new), dtype=np.int64), number))
                size += len(codes[-1])
            if size >= BLOCK_CODES:
                yield from flush()
                codes, nodes, size, seen = [], [], 0, set()
        yield from flush()
        codes, nodes, seen = [], [], set()
        give_back()

    def meet(part: pa.Table) -> pa.Table:
        pairs, _, _ = jaccard.heads(gather(part, "code", np.uint64), gather(part, "node", np.int64))
        give_back()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            yield pa.RecordBatch.from_arrays([pa.array(gather(part, c, np.int64)) for c in ("code", "node")], ["a", "b"])

    held = written(docs.select("text").mapInArrow(route, "bucket int, code binary, node binary"), "superminhash-bands")
    across = held.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, "a long, b long")
    inside = held.where("bucket < 0").select("code", "node").mapInArrow(unpack, "a long, b long")
    return components(across.unionByName(inside), "superminhash-groups").select(F.col("node").alias("lo"), F.col("component").alias("group"))


def sketch(docs: DataFrame, width: int = WORDS, slots: int = BANDS * ROWS) -> DataFrame:
    """doc_id, n_shingles and signature (binary: ``slots`` unsigned numbers of 64 bits, little-endian; null for empty sets) of every row.

    Null and empty texts, and those without words, have empty sets. Repeated rows each have a row; no rows give none. Other
    columns are ignored.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in jaccard.word_sets(batches, 1, width):
            found = [x.tobytes() if len(s) else None for x, s in zip(signatures(sets, slots), sets)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_shingles", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, n_shingles long, signature binary")


def join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, number: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the two ids are equal) for every row of ``docs`` (doc_id, text).

    Sets are of shingles of ``width`` words; links share ``percent`` hundredths of their union, confirmed on the full sets. A null or
    empty text, or one without words, has an empty set and is a component of its own. Rows with the same text are
    one component; a null id takes no part in a minimum unless there is no other. Rows that share an id and have
    different texts are different documents. Other columns are ignored; no rows give none.
    """
    found = jaccard.join(docs, width, percent, partial(grouped, number=number, rows=rows))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
