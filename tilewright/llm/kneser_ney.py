"""Perplexity by an interpolated modified Kneser-Ney n-gram model that is counted in Spark.

The model is a set of arrays in the shared folder, in shards by the leading bits of a 64-bit hash:

* words: hashes in order, with counts; a word's id is its place by frequency in its shard, times the number of
  shards, plus the shard, so frequent words have small ids. By id: how many words it follows, and of its
  successors how often they come in all, and how many come once, twice and more often.
* n-grams of each order from 2: sorted hashes, stored as a table of the leading bits and 32 bits more of each,
  with counts. Below the highest order the count is that of different words before the n-gram (for those at the
  beginning of a text, how often they occur), and the same numbers of successors stand beside it.

N-grams travel as sorted columns of ids, compressed. Counts are summed per task before they are shuffled, by a hash
of the whole n-gram: frequent words and contexts are spread over all shards. One order gives the next lower one
its contexts and the n-grams that lack the first word.

Tasks map the shards and look up the sorted keys of a block of text shard by shard, so a task holds one block
however large the model is.

    P(w|uv) = (c(uvw) - D)/c(uv.) + (D1 n1(uv) + D2 n2(uv) + D3 n3(uv))/c(uv.) * P(w|v), and so on down to
    P(w)    = (N(.w) - D')/N(..) + rest/N(..) * 1/(V + 1)

Hashes of n-grams are compared on the leading bits of the shard, of the table and 32 more, 56 bits or so in a shard
of some million; ids have 32 bits, and more words than that raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mapped
from .common import combine, gather, mix, numbered_words, power_of_two, scatter, shared_dir, volume

ORDER = 3
#: Bytes of text per shard of the model.
SHARD_BYTES = 24 << 20
#: Bytes of text that a task takes together.
BLOCK_BYTES = 3 << 20
#: Words, or n-grams, that a task sums up before it passes them on.
HELD = 2_500_000
#: The id of unknown words, and of what is not there after a text that is shorter than an n-gram.
NONE = np.uint32(0xFFFFFFFF)
#: Hashes that share an entry of the table of leading bits, on average.
IN_ENTRY = 4
VALUES = ("count", "tot", "once", "twice", "more")
#: How they travel: all but the sums are numbers of different words.
KINDS = [np.uint32, np.int64, np.uint32, np.uint32, np.uint32]


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    order: int
    tokens: int = 0
    vocabulary: int = 0
    begin: int = int(NONE)  # its id
    sizes: tuple[int, ...] = ()  # different n-grams of each order from 2
    discounts: tuple[tuple[float, ...], ...] = ()  # of each order from 1, for counts of 0, 1, 2, 3 and more
    rest: float = 1.0  # what the discounts of single words leave, as a share

    def array(self, kind: str, shard: int, name: str) -> np.ndarray:
        return mapped.load(f"{self.folder}/{kind}-{shard}.{name}.npy")

    def save(self, kind: str, shard: int, **arrays: np.ndarray) -> None:
        for name, array in arrays.items():
            mapped.save(f"{self.folder}/{kind}-{shard}.{name}.npy", array)

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, begin, end) of the parts of sorted ``keys`` that lie in each shard."""
        bounds = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        return ((s, i, j) for s, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if i < j)

    def words(self, hashes: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Ids (``NONE``: unknown) and values (0: unknown) of words, in the order of ``hashes``."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids, values = np.full(len(keys), NONE), [np.zeros(len(keys), dtype=np.int64) for _ in names]
        for s, i, j in self.parts(keys):
            held = self.array("word", s, "key")
            if not len(held):
                continue
            at = np.searchsorted(held, keys[i:j])
            at[at == len(held)] = 0
            there = np.flatnonzero(held[at] == keys[i:j])
            rank = self.array("word", s, "rank")[at[there]]
            ids[i + there] = rank.astype(np.uint64) * np.uint64(self.shards) + np.uint64(s)
            for value, name in zip(values, names):
                value[i + there] = self.array("word", s, name)[rank]
        return [x[back] for x in (ids, *values)]

    def grams(self, order: int, keys: np.ndarray) -> list[np.ndarray]:
        """``VALUES`` (0: not there) of sorted distinct n-gram hashes; the highest order has only its count."""
        values = [np.zeros(len(keys), dtype=np.int64) for _ in (VALUES if order < self.order else VALUES[:1])]
        for s, i, j in self.parts(keys):
            place = find(self.array(f"gram{order}", s, "table"), self.array(f"gram{order}", s, "rest"), keys[i:j], self.shards)
            there = np.flatnonzero(place >= 0)
            if not len(there):
                continue
            if order == self.order:
                values[0][i + there] = self.array(f"gram{order}", s, "count")[place[there]]
            else:
                rows = self.array(f"gram{order}", s, "kinds")[self.array(f"gram{order}", s, "which")[place[there]]]
                for value, column in zip(values, rows.T):
                    value[i + there] = column
        return values


#: Longer words are hashed one by one.
LANES = 8


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings: eight bytes of all of them at a time."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    at, size = at[:-1], np.diff(at)
    body = (data.to_pybytes() if data else b"") + bytes(8)
    lanes = np.ndarray(len(body) - 7, dtype="<u8", buffer=body, strides=(1,))
    out = mix(size.astype(np.uint64))
    masks = np.append((np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), ~np.uint64(0))
    for k in range(0, 8 * LANES, 8):
        rows = np.flatnonzero((size > k) & (size <= 8 * LANES))
        if not len(rows):
            continue
        out[rows] = combine(out[rows], lanes[at[rows] + k] & masks[np.minimum(size[rows] - k, 8)])
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh64_intdigest(body[at[i] : at[i] + size[i]])
    return out


#: White space is in no word, so these two are no words of any text.
BEGIN, END = word_hashes(pa.array(["\nbegin", "\nend"]))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    bits = shards.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def split_keys(keys: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading bits behind those of the shard, the 32 bits after them)."""
    own = keys << np.uint64(shards.bit_length() - 1)
    lead = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    return lead, (own << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def stored(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(table of places, 32 bits of each) of the sorted hashes of a shard."""
    bits = min(power_of_two(len(keys) / IN_ENTRY).bit_length() - 1, 31)
    lead, rest = split_keys(keys, shards, bits)
    return np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.min_scalar_type(len(keys))), rest


def find(table: np.ndarray, rest: np.ndarray, keys: np.ndarray, shards: int) -> np.ndarray:
    """Places of hashes in what :func:`stored` has made (-1: not there)."""
    lead, wanted = split_keys(keys, shards, (len(table) - 1).bit_length() - 1)
    place = np.full(len(keys), -1, dtype=np.int64)
    at, end = table[lead].astype(np.int64), table[lead + 1].astype(np.int64)
    left = np.flatnonzero(at < end)
    while len(left):
        hit = rest[at[left]] == wanted[left]
        place[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    return place


def longer(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that go on with words; a single word's is its id."""
    return combine(keys.astype(np.uint64), ids.astype(np.uint64))


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    keys = columns[0].astype(np.uint64)
    for ids in columns[1:]:
        keys = longer(keys, ids)
    return keys


def merged(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of ids with the sums of the values of equal ones, as far as these come together: in about the order of the ids.

    The order is that of the leading 64 bits of the ids, as long as the longest needs. Rows that differ behind
    these may part equal ones, which only costs a row.
    """
    if not len(columns[0]):
        return columns, values
    bits = max(1, max(int(c[c != NONE].max(initial=0)) + 1 for c in columns).bit_length())
    key, left = np.zeros(len(columns[0]), dtype=np.uint64), 64
    for c in columns:
        c = np.minimum(c, np.uint32((1 << bits) - 1)).astype(np.uint64)
        take = min(bits, left)
        key |= c >> np.uint64(bits - take) << np.uint64(left - take)
        left -= take
        if not left:
            break
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], [sums(v[order], at) for v in values]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs of whole numbers that begin at ``at``, the first at 0."""
    if not len(at):
        return values[:0]
    ends = np.cumsum(values)[np.append(at[1:], len(values)) - 1]
    return np.diff(ends, prepend=ends.dtype.type(0)).astype(values.dtype)


def distinct(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes in order, rows of ids, the sums of their values), each n-gram once."""
    keys = gram_keys(columns)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[at], [c[order[at]] for c in columns], [sums(v[order], at) for v in values]


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers and one length, bytes of one weight together, compressed; without bytes that are 0 in a whole array."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    widths = [(int(a.view(f"u{a.itemsize}").max(initial=0)).bit_length() + 7) // 8 for a in arrays]
    planes = np.empty((sum(widths), len(arrays[0])), dtype=np.uint8)
    rows = iter(planes)
    for a, width in zip(arrays, widths):
        columns = a.view(np.uint8).reshape(len(a), a.itemsize)
        for k in range(width):
            next(rows)[:] = columns[:, k]
    return len(arrays[0]).to_bytes(8, "little") + bytes(widths) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blobs: pa.ChunkedArray, kinds: list[type]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        blob = blob.as_py()
        n, head = int.from_bytes(blob[:8], "little"), 8 + len(kinds)
        rows = iter(np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[head:]), np.uint8).reshape(sum(blob[8:head]), n))
        for held, kind, width in zip(out, kinds, blob[8:head]):
            columns = np.zeros((n, np.dtype(kind).itemsize), dtype=np.uint8)
            for k in range(width):
                columns[:, k] = next(rows)
            held.append(columns.view(kind).ravel())
    return [np.concatenate(held) if held else np.empty(0, dtype=kind) for held, kind in zip(out, kinds)]


def dealt(bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, blob) that hold the elements of each bucket, in their order."""
    sizes = np.bincount(bucket)
    held, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    order = np.argsort(bucket.astype(np.min_scalar_type(len(sizes))), kind="stable")  # by radix, as long as 16 bits hold the buckets
    blobs = [packed([a[order[j - n : j]] for a in arrays]) for j, n in zip(ends[held], sizes[held])]
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of documents, hashes of different words, which of these are begin, words and end of each in a row, lengths) in blocks."""
    for batch in batches:
        ids, texts, start, size = batch.column(0), batch.column(1), 0, 0
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for k, n in enumerate(lengths.tolist()):
            size += n + 8
            if size >= BLOCK_BYTES or k == batch.num_rows - 1:
                words, which, counts = numbered_words(texts.slice(start, k + 1 - start))
                known = np.append(word_hashes(words), (BEGIN, END))
                ends = np.cumsum(counts + 2)
                framed, inner = np.empty(len(which) + 2 * len(counts), dtype=np.int32), np.ones(len(which) + 2 * len(counts), dtype=bool)
                framed[ends - counts - 2], framed[ends - 1] = len(words), len(words) + 1
                inner[ends - counts - 2] = inner[ends - 1] = False
                framed[inner] = which
                yield ids.slice(start, k + 1 - start), known, framed, counts + 2
                start, size = k + 1, 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[starts], sums(counts[order].astype(np.int64), starts)


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y else 0.5 * k
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def gram_columns(ids: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-grams of texts whose ids lie in a row, as columns. A text shorter than one is filled up with ``NONE``."""
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(ids))
    whole, short = np.flatnonzero(room >= order), (ends - lengths)[lengths < order]
    columns = []
    for k in range(order):
        filled = np.full(len(short), NONE)
        there = lengths[lengths < order] > k
        filled[there] = ids[short[there] + k]
        columns.append(np.concatenate((ids[whole + k], filled)))
    return columns


def lower(columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """What n-grams give those that are a word shorter: as contexts, how often and how variously they go on; as ends, how many words precede them."""
    real = columns[-1] != NONE
    none = lambda c, kinds: [np.zeros(len(c[0]), dtype=kind) for kind in kinds]
    contexts, own = merged(columns[:-1], [counts.astype(np.int64), *(((counts == k if k < 3 else counts > 2) & real).astype(np.uint32) for k in (1, 2, 3))])
    yield contexts, [*none(contexts, KINDS[:1]), *own]
    ends, (before,) = merged([c[real] for c in columns[1:]], [np.ones(int(real.sum()), dtype=KINDS[0])])
    yield ends, [before, *none(ends, KINDS[1:])]


def tally(counts: np.ndarray) -> list[int]:
    """How many there are, and how many of counts 1 to 4 and above 2."""
    return [int((counts > 0).sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 2).sum())]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of the texts of ``docs`` (doc_id, text), of n-grams of up to ``order`` (2 or more) words.

    Null texts count as empty ones; no documents, no words. Repeated rows count each; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shards = power_of_two(volume(docs)[1] / SHARD_BYTES)
    plan = Model(f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}", shards, order)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, size = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), [], 0
        for _, known, which, _ in sequences(batches):
            counts = np.bincount(which, minlength=len(known))
            there = np.flatnonzero(counts)
            new.append((known[there], counts[there]))
            size += len(there)
            if size > HELD // 2:
                held, new, size = summed(*(np.concatenate(x) for x in zip(held, *new))), [], 0
            if len(held[0]) > HELD:
                yield scatter(shard_of(held[0], shards), list(held), ["key", "count"])
                held = (held[0][:0], held[1][:0])
        held = summed(*(np.concatenate(x) for x in zip(held, *new)))
        yield scatter(shard_of(held[0], shards), list(held), ["key", "count"])

    def merge_words(key: tuple, part: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = summed(gather(part, "key", np.uint64), gather(part, "count", np.int64))
        by_rank = np.argsort(-counts, kind="stable")
        rank = np.empty(len(keys), dtype=np.uint32)
        rank[by_rank] = np.arange(len(keys))
        if len(keys) * shards >= int(NONE):
            raise ValueError("more words than ids of 32 bits")
        plan.save("word", shard, key=keys, rank=rank, raw=narrow(counts[by_rank]))
        begin = np.flatnonzero(keys == BEGIN)
        own = [len(keys), int(counts.sum()), int(counts[begin].sum()), int(rank[begin[0]]) * shards + shard if len(begin) else -1]
        return pa.table({"shard": pa.array([shard], pa.int32()), "own": pa.array([own], pa.list_(pa.int64()))})

    blobs = docs.mapInArrow(count_words, "bucket int, key binary, count binary")
    made = {r["shard"]: r["own"] for r in blobs.groupBy("bucket").applyInArrow(merge_words, "shard int, own array<long>").collect()}
    for s in range(shards):  # shards of small inputs may have no word
        if s not in made:
            plan.save("word", s, key=np.empty(0, dtype=np.uint64), **{n: np.empty(0, dtype=np.uint8) for n in ("rank", "raw", *VALUES)})
    words, tokens, begins = (sum(r[k] for r in made.values()) for k in range(3))
    begin = max((r[3] for r in made.values()), default=-1)
    if begin < 0:
        return plan
    sizes = {s: r[0] for s, r in made.items()}

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, new, size = [np.empty(0, dtype=np.uint32)] * order, np.empty(0, dtype=np.int64), [], 0

        def added() -> tuple[list[np.ndarray], np.ndarray]:
            columns = [np.concatenate(c) for c in zip(held, *new)]
            columns, (n,) = merged(columns, [np.append(counts, np.ones(len(columns[0]) - len(counts), dtype=np.int64))])
            return columns, n

        for _, known, which, lengths in sequences(batches):
            new.append(gram_columns(plan.words(known, ())[0][which], lengths, order))
            size += len(new[-1][0])
            if size > HELD // 2:
                (held, counts), new, size = added(), [], 0
            if len(counts) > HELD:
                yield dealt(shard_of(gram_keys(held), shards), [*held, counts])
                held, counts = [c[:0] for c in held], counts[:0]
        held, counts = added()
        yield dealt(shard_of(gram_keys(held), shards), [*held, counts])

    def passed_on(level: int, columns: list[np.ndarray], counts: np.ndarray, numbers: list[int]) -> pa.Table:
        """Rows for the next lower order; those of negative buckets hold the numbers of the order itself."""
        out = [dealt(shard_of(gram_keys(c), shards) if level > 2 else (c[0] % np.uint32(shards)).astype(np.int64), [*c, *v]) for c, v in lower(columns, counts) if len(c[0])]
        return pa.Table.from_batches([*out, numbers_row(level, numbers)])

    def numbers_row(level: int, numbers: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-level], pa.int64()), pa.array([packed([np.array(numbers, dtype=np.int64)])], pa.binary())], ["bucket", "blob"])

    def merge(level: int):
        """Sums up n-grams of an order, stores them, and gives what the next lower order needs."""

        def of(key: tuple, part: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            if shard < 0:  # numbers of a higher order
                (numbers,) = unpacked(part.column("blob"), [np.int64])
                return pa.Table.from_batches([numbers_row(-shard, numbers.tolist())])
            top = level == order
            arrays = unpacked(part.column("blob"), [np.uint32] * level + ([np.int64] if top else KINDS))
            if level == 1:
                table = np.zeros((sizes[shard], 5), dtype=np.int64)
                np.add.at(table, (arrays[0] // np.uint32(shards)).astype(np.int64), np.stack(arrays[1:], axis=1))
                plan.save("word", shard, **{n: narrow(table[:, k]) for k, n in enumerate(VALUES)})
                return pa.Table.from_batches([numbers_row(1, [shard, *tally(table[:, 0])])])
            keys, columns, values = distinct(arrays[:level], arrays[level:])
            del arrays
            if not top:
                values[0] = np.where(columns[0] == np.uint32(begin), values[1], values[0])
            real = np.flatnonzero(columns[-1] != NONE)
            table, rest = stored(keys[real], shards)
            if top:
                kept = {"count": narrow(values[0][real])}
            else:
                kinds, which = alike([v[real] for v in values])
                kept = {"kinds": kinds, "which": which}
            plan.save(f"gram{level}", shard, table=table, rest=rest, **kept)
            return passed_on(level, columns, values[0], [shard, *tally(values[0][real])])

        return of

    rows = docs.mapInArrow(count_grams, "bucket long, blob binary")
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(merge(level), "bucket long, blob binary")
    numbers = {level: np.empty((0, 7), dtype=np.int64) for level in range(1, order + 1)}  # per shard: itself, and its tally
    for r in rows.collect():  # a row per shard for each order
        own = unpacked(pa.chunked_array([pa.array([r["blob"]])]), [np.int64])[0].reshape(-1, 7)
        numbers[-r["bucket"]] = np.concatenate((numbers[-r["bucket"]], own))
    for level in range(2, order + 1):
        for s in set(range(shards)) - set(numbers[level][:, 0].tolist()):  # shards of small inputs may have no n-gram
            plan.save(f"gram{level}", s, table=np.zeros(2, dtype=np.uint8), rest=np.empty(0, dtype=np.uint32))
    sums = {level: own[:, 1:].sum(axis=0).tolist() for level, own in numbers.items()}
    kept = tuple(discounts(sums[level][1:5]) for level in range(1, order + 1))
    pairs, single = sums[2][0], sums[1]
    rest = (kept[0][1] * single[1] + kept[0][2] * single[2] + kept[0][3] * single[5]) / pairs if pairs else 1.0
    return Model(plan.folder, shards, order, tokens - begins, words - 1, begin, tuple(sums[level][0] for level in range(2, order + 1)), kept, rest)


def alike(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(different rows of values, which of them each row is)."""
    code = np.zeros(len(values[0]), dtype=np.uint64)
    for v in values:
        code = combine(code, v.astype(np.uint64))
    kinds, which = np.unique(code, return_inverse=True)
    one = np.empty(len(kinds), dtype=np.int64)  # a row of each kind
    one[which] = np.arange(len(which))
    return np.stack([v[one] for v in values], axis=1), which.astype(np.min_scalar_type(max(len(kinds), 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: log10 probabilities of whole texts, the end included.

    Null texts count as empty ones and still have their end; repeated rows are scored each, a null id stays null,
    other columns are ignored, an empty table gives no rows. Under a model of nothing all tokens are alike.
    """
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, known, which, lengths in sequences(batches):
            if not model.tokens:  # nothing learned: all words are alike
                flat = -np.log10(model.vocabulary + 1.0) * (lengths - 1)
                yield pa.RecordBatch.from_arrays([doc, pa.array(lengths - 1), pa.array(lengths * 0), pa.array(flat), pa.array(flat)], names)
                continue
            starts = np.cumsum(lengths) - lengths
            place = np.arange(len(which)) - np.repeat(starts, lengths)  # in its text; 0 is its begin
            ids, raw, *values = model.words(known, ("raw", *VALUES))
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))[which]
            ids, raw, *values = (x[which] for x in (ids, raw, *values))
            d = np.array(model.discounts[0])
            p = model.rest / (model.vocabulary + 1) + np.maximum(values[0] - d[np.minimum(values[0], 3)], 0) / max(model.sizes[0], 1)
            keys = ids.astype(np.uint64)
            for order in range(2, model.order + 1):
                at = np.flatnonzero(place >= order - 1)
                own = longer(keys[at - 1], ids[at])
                sorted_keys, back = np.unique(own, return_inverse=True)
                found = [v[back] for v in model.grams(order, sorted_keys)]
                total, *more = (v[at - 1] for v in values[1:])  # of the context
                d = np.array(model.discounts[order - 1])
                high = np.maximum(found[0] - d[np.minimum(found[0], 3)], 0) + sum(d[k] * n for k, n in zip((1, 2, 3), more)) * p[at]
                p[at] = np.where(total > 0, high / np.maximum(total, 1), p[at])
                keys = np.zeros(len(ids), dtype=np.uint64)
                keys[at] = own
                values = [np.zeros(len(ids), dtype=np.int64) for _ in found]
                for v, f in zip(values, found):
                    v[at] = f
            scored = place > 0
            sums = np.cumsum(lengths - 1) - (lengths - 1)
            add = lambda x: np.add.reduceat(x[scored], sums)
            yield pa.RecordBatch.from_arrays([doc, pa.array(lengths - 1), pa.array(add((raw > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], names)

    return docs.select("doc_id", "text").mapInArrow(probabilities, "doc_id long, n_tokens long, n_known long, base_score double, score double")
