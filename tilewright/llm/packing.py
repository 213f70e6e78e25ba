"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents become token ids (a public tokenizer, one closing id); every full window is cut off and the rest,
shorter than a window, is what has to be packed. Pieces are dealt by their content, equal ones by their number
too, into groups of bounded size whatever the ids are, and each group is partitioned by differencing: all partial partitions wait in a heap by the spread of their sums,
and the two widest merge with their imbalances opposed (largest sum onto smallest). If the fullest window
exceeds the capacity, the group tries again with more windows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: Documents in a group, on average.
GROUP_DOCS = 768
#: Chunks and runs of letters whose ids a worker keeps.
CHUNKS, RUNS = 300_000, 1_200_000
#: Latin letters that case folding and normal form C map one to one, then marks other than the apostrophe.
PLAIN_CHUNK = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
#: Documents that are tokenized together.
BLOCK_DOCS = 1500

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ChunkIds:
    """Little-endian uint32 ids of white-space-free chunks, behind caches of bounded size.

    The tokenizer drops white space and none of its tokens, special ones included, spans any, so a text's ids are
    those of its chunks.
    It also lowers letters and parts a run of letters from the marks after it, so common chunks of Latin
    letters and marks are put together from the ids of these two. Unknown runs of letters are encoded many at
    a time: each ends with a token that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def of(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.chunks.get, chunks))
        missing = [k for k, ids in enumerate(out) if ids is None]
        plain = {k: m.groups() for k in missing if (m := PLAIN_CHUNK.fullmatch(chunks[k]))}
        lowered = {k: letters.lower() for k, (letters, _) in plain.items()}
        runs = {run: self.runs.get(run) for run in {*lowered.values(), *(marks for _, marks in plain.values())}}
        new = [run for run, ids in runs.items() if ids is None]
        words = [run for run in new if run[:1].isalpha()]
        for i in range(0, len(words), 256):
            group = words[i : i + 256]
            ids = self.encode(" ".join(group))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):
                continue
            for run, start, end in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
                runs[run] = ids[start:end].tobytes()
        for run in new:
            if runs[run] is None:
                runs[run] = self.encode(run).tobytes()
        keep(self.runs, RUNS, ((run, runs[run]) for run in new))
        for k in missing:
            out[k] = runs[lowered[k]] + runs[plain[k][1]] if k in plain else self.encode(chunks[k]).tobytes()
        keep(self.chunks, CHUNKS, ((chunks[k], out[k]) for k in missing))
        return out


def keep(cache: dict[str, bytes], most: int, new: Iterable[tuple[str, bytes]]) -> None:
    for text, ids in new:
        if len(text) <= 64:
            if len(cache) >= most:
                cache.clear()
            cache[text] = ids


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def token_ids(texts: pa.Array, cache: ChunkIds) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, numbers of ids of each). Each distinct chunk of the texts is looked up once."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    held = cache.of(coded.dictionary.to_pylist())
    which = coded.indices.to_numpy()
    lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
    starts = np.cumsum(lengths) - lengths
    of_word = lengths[which]
    stops = np.cumsum(of_word)
    ids = np.frombuffer(b"".join(held), dtype="<u4")[np.arange(int(of_word.sum())) + np.repeat(starts[which] - (stops - of_word), of_word)]
    words = np.append(0, stops)[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return ids, np.diff(words)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document cut at multiples of ``capacity``."""
    closing = np.array([end_id], dtype="<u4")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_ids(tokenizer_path)
        for batch in rows:
            for i in range(0, batch.num_rows, BLOCK_DOCS):
                out: list[list] = [[], [], [], [], []]
                ids, counts = token_ids(batch.column(1).slice(i, BLOCK_DOCS), cache)
                stops = np.cumsum(counts).tolist()
                for doc, begin, stop in zip(batch.column(0).slice(i, BLOCK_DOCS).to_pylist(), [0, *stops[:-1]], stops):
                    own = np.append(ids[begin:stop], closing)
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity]
                        for column, value in zip(out, (doc, start, len(part), zlib.crc32(part), len(own))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``windows`` groups of nearly equal sums."""
    if windows <= 1:
        return [list(range(len(sizes)))]
    count = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), count + len(merges), sums))
        merges.append((left, right, order))
    # From the last merge back to the single sizes: which window each part of a partition ends up in.
    window_of = {heap[0][1]: np.arange(windows)}
    for k in range(len(merges) - 1, -1, -1):
        left, right, order = merges[k]
        own = window_of.pop(count + k)
        window_of[left], window_of[right] = np.empty(windows, dtype=np.int64), np.empty(windows, dtype=np.int64)
        window_of[left][order] = own
        window_of[right][windows - 1 - order] = own
    groups: list[list[int]] = [[] for _ in range(windows)]
    for i in range(count):
        groups[int(window_of[i][0])].append(i)
    return groups


def windows_for(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Groups of indexes with sums of at most ``capacity``; their number rises until they fit."""
    if not sizes:
        return []
    count = max(1, math.ceil(sum(sizes) / capacity), sum(2 * s > capacity for s in sizes))
    while True:
        groups = [g for g in differencing(sizes, count) if g]
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        count += max(1, count // 100)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text still has its closing id. Repeated rows are packed each; a null id is kept as null.
    An empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, tokenizer_path, capacity, end_id)
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))
    names = cut.columns
    # Equal pieces are counted and dealt again by number, in two steps so that no list of numbers is long.
    lots = cut.groupBy(*names).agg(F.count("*").alias("copies"))
    lots = lots.withColumn("high", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)")))
    lots = lots.withColumn("low", F.explode(F.expr("sequence(0L, least(4095L, copies - 1 - high * 4096))")))
    dealt = lots.select(*names, F.pmod(F.xxhash64(*names, "high", "low"), F.lit(groups)).alias("group"))

    def place(key: tuple, part: pa.Table) -> pa.Table:
        part = part.drop_columns(["group"]).sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        length = part.column("length").to_numpy()
        base = key[0].as_py() << 32
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        full = np.flatnonzero(length == capacity)
        sequence[full] = base + np.arange(len(full))
        rest = np.flatnonzero(length < capacity)
        for k, members in enumerate(windows_for([int(x) for x in length[rest]], capacity)):
            at = rest[members]
            sequence[at] = base + len(full) + k
            offset[at] = np.cumsum(length[at]) - length[at]
        return part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(place, PIECES + ", sequence_id long, offset long")
