"""N-gram Jaccard join of all texts by prefix trees, exact at its threshold.

1. Every text becomes its set of word shingles; equal sets are one node from here on, told apart by 128 bits.
2. Nodes are routed: if two sets with larger size h are similar enough, they differ in at most D(h) elements,
   so of p > D parts of the hash range at least p - D hold the same elements in both. Nodes with an equal part
   are joined to groups, which no similar pair leaves. Parts of a few elements, and elements of passages that many
   texts share, are left out as long as they cannot be all that is equal.
3. In a group the sets are ordered by one order of elements (frequent ones first) and stored in a trie with
   compressed paths. The order is the same for all sets that may be compared, as no pair leaves its group. A
   search walks the trie level by level: subtrees share the overlap of their path, and are cut off when the
   elements that remain on either side cannot reach the threshold. Sets that were reached already are not
   searched for again, so dense groups cost little more than one search.
4. The links that join different sets make up the components.

Groups beyond ``GROUP_ELEMENTS`` are split in blocks, each searched by a task of its own together with the group's
pivot, one of its sets. What is joined to the pivot is joined across blocks; only the sets that are not, few in a
group of near copies, are searched for in all blocks.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, components, gather, give_back, hashed_words, mix, power_of_two, quoted, scatter, shingles, spread_join, volume, written

WORDS = 3
#: Links have 100 * intersection >= PERCENT * union. Other shares than this (below 100) are a parameter.
PERCENT = 90
GROUP_ELEMENTS = 3_000_000
BUCKET_BYTES = 48 << 20
LEAST_IN_PART = 3
BLOCK_PARTS = 2_000_000
#: Bytes of different texts that frequent elements are sought in, how many of their sets have one, and the bits of the table of counts.
SAMPLE_BYTES, LEAST_IN_SAMPLE, TABLE_BITS = 8 << 20, 5, 22
#: Keys of rows that a task remembers, to pass repeated rows on once.
SEEN_ROWS = 1_000_000


@lru_cache(maxsize=8)
def band_limits(percent: int = PERCENT) -> list[int]:
    limits = [100 // (100 - percent) - 1]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] + 1, limits[-1] * 13 // 10))
    return limits


def differing(size: int, percent: int = PERCENT) -> int:
    """The most elements in which two linked sets of at most ``size`` elements differ."""
    return 2 * size * (100 - percent) // (100 + percent)


#: A table of frequent elements that has none.
NONE_FREQUENT = np.zeros(1, dtype=bool)


def coded(sums: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the chosen parts, each with its number."""
    place = np.arange(1, len(bounds), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.uint64(salt) + place)[chosen]


def in_parts(elements: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins in a sorted set, and the end."""
    at = ((elements >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))


def signatures(elements: np.ndarray, percent: int = PERCENT, frequent: np.ndarray = NONE_FREQUENT) -> np.ndarray:
    """Hashes of the parts of a sorted set, for each band of sizes in which a linked set may be the larger one.

    The elements that the table ``frequent`` marks (by their lowest bits) are one part, which is left out; the others are
    spread over the rest. Sets of which this leaves too few parts, as they hold little else, have the parts of all their elements as well.
    """
    n, out, limits = len(elements), [], band_limits(percent)
    rare = elements[~frequent[(elements & np.uint64(len(frequent) - 1)).astype(np.int64)]]
    sums, rare_sums = (np.append(np.uint64(0), np.cumsum(mix(x))) for x in (elements, rare))
    for band in range(bisect_left(limits, n), bisect_left(limits, n * 100 // percent) + 1):
        most = differing(limits[band], percent)
        # Of most + 2 + most // 4 parts, one of them frequent, most may differ. Equal parts are of one size: parts of
        # a few elements are left out where that many cannot be all the others.
        parts = most + 1 + most // 4
        bounds = in_parts(rare, parts)
        sizes = np.diff(bounds)
        for least in range(LEAST_IN_PART, 0, -1):
            full = sizes >= least
            if parts - int(full.sum()) < parts - most:
                break
        else:
            every = in_parts(elements, parts)
            for least in range(LEAST_IN_PART, 0, -1):
                large = np.diff(every) >= least
                if parts - int(large.sum()) < parts - most:
                    break
            else:
                large = np.ones(parts, dtype=bool)
            out.append(coded(sums, every, large, (band << 40) + 1))
        out.append(coded(rare_sums, bounds, full, band << 40))
    return np.concatenate(out)


class Trie:
    """Sorted rank sequences in a trie with compressed paths, as arrays in order of levels."""

    def __init__(self, sets: dict[int, np.ndarray]):
        order = sorted(sets, key=lambda k: sets[k].astype(">u4").tobytes())
        parent, source, start, end, owner = [-1], [-1], [0], [0], [-1]
        stack, before = [0], None
        for k in order:
            now = sets[k]
            if before is None:
                common = 0
            else:
                m = min(len(before), len(now))
                differs = before[:m] != now[:m]
                common = int(differs.argmax()) if differs.any() else m
            last = -1
            while end[stack[-1]] > common:
                last = stack.pop()
            if end[stack[-1]] < common:
                parent.append(stack[-1]), source.append(source[last]), start.append(end[stack[-1]]), end.append(common), owner.append(-1)
                parent[last], start[last] = len(parent) - 1, common
                stack.append(len(parent) - 1)
            parent.append(stack[-1]), source.append(k), start.append(common), end.append(len(now)), owner.append(k)
            stack.append(len(parent) - 1)
            before = now
        n = len(parent)
        level, low, high = [0] * n, [1 << 60] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[parent[v]].append(v)
        walk = [0]
        for v in walk:
            for c in children[v]:
                level[c] = level[v] + 1
                walk.append(c)
        for v in reversed(walk):
            if owner[v] >= 0:
                low[v], high[v] = min(low[v], end[v]), max(high[v], end[v])
            if v:
                low[parent[v]], high[parent[v]] = min(low[parent[v]], low[v]), max(high[parent[v]], high[v])
        place = {v: i for i, v in enumerate(walk)}  # walk is in order of levels
        self.owner = np.array([owner[v] for v in walk])
        self.depth = np.array([end[v] for v in walk])
        self.low, self.high = np.array([low[v] for v in walk]), np.array([high[v] for v in walk])
        held = [sets[source[v]][start[v] : end[v]] if v else np.empty(0, dtype=np.int64) for v in walk]
        self.tokens = np.concatenate(held)
        self.bounds = np.append(0, np.cumsum([len(x) for x in held]))
        firsts = [[place[c] for c in children[v]] for v in walk]
        self.child_at = np.append(0, np.cumsum([len(c) for c in firsts]))
        self.children = np.array([c for cs in firsts for c in cs], dtype=np.int64)
        self.last = np.array([x[-1] if len(x) else -1 for x in held])

    def search(self, probe: np.ndarray, marks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Owners of the sets that link with ``probe``; ``marks`` is all false and stays so."""
        a = len(probe)
        marks[probe] = True
        nodes, overlap, found = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        while len(nodes):
            counts = self.child_at[nodes + 1] - self.child_at[nodes]
            total = int(counts.sum())
            if not total:
                break
            steps = np.arange(total) + np.repeat(self.child_at[nodes] - (np.cumsum(counts) - counts), counts)
            below = np.repeat(overlap, counts)
            nodes = self.children[steps]
            lengths = self.bounds[nodes + 1] - self.bounds[nodes]  # never 0
            starts = np.cumsum(lengths) - lengths
            tokens = self.tokens[np.arange(int(lengths.sum())) + np.repeat(self.bounds[nodes] - starts, lengths)]
            overlap = below + np.add.reduceat(marks[tokens], starts, dtype=np.int64)
            depth = self.depth[nodes]
            rest = a - np.searchsorted(probe, self.last[nodes], side="right")
            best = np.clip(depth + rest, self.low[nodes], self.high[nodes])
            alive = (100 + percent) * (overlap + np.minimum(best - depth, rest)) >= percent * (a + best)
            nodes, overlap = nodes[alive], overlap[alive]
            owner, depth = self.owner[nodes], depth[alive]
            hit = (owner >= 0) & ((100 + percent) * overlap >= percent * (a + depth))
            found.append(owner[hit])
        marks[probe] = False
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Sets of hashes as sorted ranks of their elements, the most frequent first."""
    _, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return [np.sort(x) for x in np.split(rank[local], np.cumsum([len(s) for s in sets])[:-1])]


def linked(sets: list[np.ndarray], every: bool = False, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join every component of the sets (of hashes); a link within what is joined already may lack.

    With ``every`` all links, the smaller index first.
    """
    ordered = ranked(sets)
    marks = np.zeros(max(int(r[-1]) for r in ordered) + 1, dtype=bool)
    waiting = dict.fromkeys(range(len(sets)))
    edges, trie, built = [], None, 0
    if every:
        trie = Trie(dict(enumerate(ordered)))
        return [(k, j) for k in waiting for j in trie.search(ordered[k], marks, percent).tolist() if k < j]
    while waiting:
        todo = [next(iter(waiting))]
        del waiting[todo[0]]
        while todo and waiting:
            now = todo.pop()
            if trie is None or 2 * len(waiting) < built:
                trie, built = Trie({k: ordered[k] for k in waiting}), len(waiting)
            for k in trie.search(ordered[now], marks, percent).tolist():
                if k in waiting:
                    del waiting[k]
                    edges.append((now, k))
                    todo.append(k)
    return edges


def sets_of_texts(texts: pa.Array, width: int) -> list[np.ndarray]:
    hashes, counts = hashed_words(texts)
    return [shingles(x, width) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def word_sets(batches: Iterator[pa.RecordBatch], column: int, width: int = WORDS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            yield part, sets_of_texts(part.column(column), width)


def node_of(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; zeros for the empty one."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(elements.tobytes())) if len(elements) else (0, 0)


def measured(docs: DataFrame, width: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(every row of ``docs`` (doc_id, text, h): doc_id, h, n_shingles, hi, lo; every distinct set: vid, hi, lo, doc_id, h, n, rows).

    ``h`` is a hash of the text. ``vid`` grows with the smallest id that has the set; ``doc_id`` and ``h`` name a row of it.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in word_sets(batches, 1, width):
            nodes = np.array([node_of(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes[:, 0]), pa.array(nodes[:, 1])], ["doc_id", "h", "n_shingles", "hi", "lo"])

    sized = written(docs.mapInArrow(measure, "doc_id long, h long, n_shingles long, hi long, lo long"), "jaccard-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    nodes = sized.where("n_shingles > 0").groupBy("hi", "lo").agg(first, F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    nodes = nodes.select("hi", "lo", "first.doc_id", "first.h", "n", "rows")
    order = [F.col("doc_id").asc_nulls_last(), F.col("hi").asc(), F.col("lo").asc()]
    nodes = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("vid", F.monotonically_increasing_id())
    return sized, written(nodes, "jaccard-nodes")


def frequent_elements(docs: DataFrame, width: int, size: int) -> np.ndarray:
    """A table of 2 ** ``TABLE_BITS`` marks: places of elements that ``LEAST_IN_SAMPLE`` different texts of a sample have.

    These are of passages that many texts share. The sample has about ``SAMPLE_BYTES`` of the ``size`` bytes of all texts; counts are
    added up by place, so neither tasks nor the driver hold more than the table. What is marked, by chance as well, decides on the
    work only, not on the links that are found.
    """
    places = 1 << TABLE_BITS
    stretch = places >> 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(places, dtype=np.uint8)
        for _, sets in word_sets(batches, 0, width):
            for elements in sets:
                at = np.unique((elements & np.uint64(places - 1)).astype(np.int64))
                counts[at] += counts[at] < 255
        held = counts.reshape(-1, stretch)
        used = np.nonzero(held.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([held[k].tobytes() for k in used], pa.binary())], ["stretch", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.uint8).astype(np.int64) for x in part.column("counts"))
        return pa.table({"stretch": part.column("stretch").slice(0, 1), "marks": pa.array([np.packbits(total >= LEAST_IN_SAMPLE).tobytes()], pa.binary())})

    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    drawn = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    texts = drawn.groupBy("h").agg(F.first("text").alias("text")).select("text")
    marks = np.zeros(places, dtype=bool)
    found = texts.mapInArrow(count, "stretch int, counts binary").groupBy("stretch").applyInArrow(add, "stretch int, marks binary")
    for r in found.collect():  # 64 rows of marks
        marks[r["stretch"] * stretch : (r["stretch"] + 1) * stretch] = np.unpackbits(np.frombuffer(r["marks"], dtype=np.uint8))
    return marks


def heads(code: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows of a node and the smallest node that has a code of it, where they differ; the distinct codes; their smallest nodes)."""
    order = np.lexsort((node, code))
    code, node = code[order], node[order]
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    head = node[np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))] if len(code) else node
    apart = head != node
    pairs = np.unique(np.stack((node[apart], head[apart]), axis=1), axis=0) if apart.any() else np.empty((0, 2), dtype=np.int64)
    return pairs, code[first], node[first]


def grouped(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """lo, group: sets with an equal part are in one group; sets without any are in none.

    Sets go by half of their bits here: those that share it are in one group, and told apart when they are compared.
    """
    # Both the parts of a set and the bands that it is in grow with what may differ.
    size = volume(docs)[1]
    buckets = power_of_two(size / BUCKET_BYTES * max(1, differing(1000, percent) / differing(1000)) ** 2)
    frequent = frequent_elements(docs, width, size)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, nodes, size, seen = [], [], 0, set()

        def flush() -> pa.RecordBatch:
            code = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
            node = np.concatenate(nodes) if nodes else np.empty(0, dtype=np.int64)
            return scatter((code & np.uint64(buckets - 1)).astype(np.int64), [code, node], ["code", "node"])

        for _, sets in word_sets(batches, 0, width):
            for elements in sets:
                if len(elements) == 0 or (node := node_of(elements)[1]) in seen:
                    continue
                seen.add(node)
                code = signatures(elements, percent, frequent)
                codes.append(code)
                nodes.append(np.full(len(code), node, dtype=np.int64))
                size += len(code)
            if size >= BLOCK_PARTS:
                yield flush()
                codes, nodes, size, seen = [], [], 0, set()
        yield flush()

    def meet(part: pa.Table) -> pa.Table:
        pairs, _, _ = heads(gather(part, "code", np.uint64), gather(part, "node", np.int64))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    routed = docs.select("text").mapInArrow(route, "bucket int, code binary, node binary").groupBy("bucket").applyInArrow(meet, "a long, b long")
    return components(routed, "jaccard-groups").select(F.col("node").alias("lo"), F.col("component").alias("group"))


def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, h), repeated ones mostly left out."""
    seen: set[tuple] = set()
    for batch in batches:
        if len(seen) > SEEN_ROWS:
            seen.clear()
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep))


LINKS = "a long, b long"


def pair_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


#: Rows (doc_id, text, h), width and percent to rows (lo, group).
Router = Callable[[DataFrame, int, int], DataFrame]


def found_links(docs: DataFrame, nodes: DataFrame, every: bool, width: int = WORDS, percent: int = PERCENT, route: Router = grouped) -> DataFrame:
    """a, b: links between distinct sets, by their vid; enough to join the components, or all. ``route`` says which sets are compared."""
    members = written(route(docs, width, percent).join(nodes, "lo"), "jaccard-members")
    sums = members.groupBy("group").agg(F.sum("n").alias("elements"), F.min("vid").alias("pivot"))
    lots = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // GROUP_ELEMENTS))
    sums = sums.withColumn("blocks", F.ceil(F.col("elements") / GROUP_ELEMENTS).cast("int"))
    members = spread_join(members, sums.drop("elements"), ["group"])
    members = members.withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    rows = docs.mapInArrow(once_a_task, docs.schema)
    same_row = F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.h") == F.col("d.h"))

    def with_texts(chosen: DataFrame) -> DataFrame:
        return rows.alias("d").join(chosen.hint("merge").alias("m"), same_row).select("d.text", *(F.col(f"m.{c}") for c in chosen.columns if c not in ("doc_id", "h")))

    def sets_of(part: pa.Table) -> tuple[dict[int, np.ndarray], pa.Table]:
        """(sets by vid, the rows that hold them): a row whose text is another one, by a hash that is equal, drops out."""
        sets, fine = {}, []
        every = (x for chunk in part.column("text").chunks for i in range(0, len(chunk), 500) for x in sets_of_texts(chunk.slice(i, 500), width))
        for vid, hi, lo, elements in zip(*(part.column(c).to_pylist() for c in ("vid", "hi", "lo")), every):
            fine.append(node_of(elements) == (hi, lo))
            if fine[-1]:
                sets[vid] = elements
        return sets, part.drop_columns(["text"]).filter(pa.array(fine, pa.bool_()))

    def search(part: pa.Table) -> pa.Table:
        """Links inside blocks, and between two blocks where the rows come from two."""
        sets, part = sets_of(part)
        group, block = (dict(zip(part.column("vid").to_pylist(), part.column(c).to_pylist())) for c in ("group", "own"))
        by_group: dict[int, list[int]] = {}
        for vid in sorted(sets):
            by_group.setdefault(group[vid], []).append(vid)
        across = len(part) > 0 and part.column("i")[0] != part.column("j")[0]  # pairs inside a block have a task of their own
        found = []
        for ids in by_group.values():
            pairs = ((ids[a], ids[b]) for a, b in linked([sets[i] for i in ids], every, percent))
            found += [(a, b) for a, b in pairs if not (across and block[a] == block[b])]
        del sets
        give_back()
        return pair_table(found)

    one = F.lit(0)
    if every:  # all pairs of blocks, as all links between them are wanted
        others = F.when(F.col("blocks") > 1, F.sequence(one, F.col("blocks") - 1)).otherwise(F.array(one))
        dealt = members.select("vid", "hi", "lo", "doc_id", "h", "group", "own", F.explode(others).alias("other"), lot_of(lots).alias("lot"))
        dealt = dealt.select("vid", "hi", "lo", "doc_id", "h", "group", "own", "lot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        return with_texts(dealt).groupBy("lot", "i", "j").applyInArrow(search, LINKS)

    # The pivot of a split group goes to all of its blocks.
    everywhere = F.when((F.col("blocks") > 1) & (F.col("vid") == F.col("pivot")), F.sequence(one, F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = members.select("vid", "hi", "lo", "doc_id", "h", "group", F.explode(everywhere).alias("own"), lot_of(lots).alias("lot"))
    dealt = dealt.withColumns({"i": F.col("own"), "j": F.col("own")})
    inside = written(with_texts(dealt).groupBy("lot", "i", "j").applyInArrow(search, LINKS), "jaccard-inside")
    split = members.where("blocks > 1")
    if split.isEmpty():
        return inside
    # Sets of split groups that are not joined to their pivot yet are searched for in all blocks.
    so_far = components(inside, "jaccard-blocks")
    split = split.join(so_far.select(F.col("node").alias("vid"), "component"), "vid", "left").join(so_far.select(F.col("node").alias("pivot"), F.col("component").alias("main")), "pivot", "left")
    apart = ~F.coalesce("component", "vid").eqNullSafe(F.coalesce("main", "pivot"))
    split = written(split.withColumn("apart", apart), "jaccard-split")
    loads = split.where("apart").groupBy("group").agg(F.ceil(F.sum("n") / GROUP_ELEMENTS).cast("int").alias("loads"))
    probes = split.where("apart").join(loads, "group").withColumns({"load": F.pmod(F.xxhash64("vid"), F.col("loads")).cast("int"), "block": F.explode(F.sequence(one, F.col("blocks") - 1))})
    held = split.join(loads, "group").withColumns({"load": F.explode(F.sequence(one, F.col("loads") - 1)), "block": F.col("own")})
    columns = ["vid", "hi", "lo", "doc_id", "h", "group", "load", "block"]
    dealt = probes.select(*columns).unionByName(held.select(*columns))

    def ask(part: pa.Table) -> pa.Table:
        sets, _ = sets_of(part)
        ids = sorted(sets)
        return pair_table([(ids[a], ids[b]) for a, b in linked([sets[v] for v in ids], False, percent)] if ids else [])

    return inside.unionByName(with_texts(dealt).groupBy("group", "load", "block").applyInArrow(ask, LINKS))


def lot_of(lots: int) -> Column:
    return F.when(F.col("blocks") > 1, F.col("group")).otherwise(F.pmod("group", F.lit(lots)))


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))


def classes(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, route: Router = grouped) -> tuple[DataFrame, DataFrame]:
    """(the rows as :func:`measured` gives them; per distinct set: hi, lo, doc_id, h, rows, vid, component, the smallest vid that links reach)."""
    sized, nodes = measured(docs, width)
    joined = components(found_links(docs, nodes, False, width, percent, route), "jaccard-links").select(F.col("node").alias("vid"), "component")
    return sized, nodes.join(joined, "vid", "left").withColumn("component", F.coalesce("component", "vid"))


def join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, route: Router = grouped) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Sets are of shingles of ``width`` words; links share ``percent`` hundredths of their union. ``route`` says which sets are compared.

    A null or empty text, or one without words, has an empty set and is a component of its own. Rows with the
    same text are one component; a null id takes no part in a minimum unless there is no other. Rows that share
    an id and have different texts are different documents. Other columns are ignored; no rows give none.
    """
    docs = with_hash(docs)
    sized, sets = classes(docs, width, percent, route)
    sets = written(sets, "jaccard-classes")
    roots = sets.where("vid = component").select("component", F.col("doc_id").alias("component_id"))
    named = spread_join(sets.select("hi", "lo", "component"), roots, ["component"]).select("hi", "lo", "component_id")
    full, empty = sized.where("n_shingles > 0"), sized.where("n_shingles = 0")
    out = spread_join(full.select("doc_id", "n_shingles", "hi", "lo"), named, ["hi", "lo"])
    return out.select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_of_groups(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, route: Router = grouped) -> DataFrame:
    """The rows of ``docs``, same columns, of which each group of similar texts has one: one with its smallest id.

    Texts without words are in no group and all stay. Groups are those of :func:`join`; rows without an id are
    kept only where no row of their group has one.
    """
    _, sets = classes(with_hash(docs), width, percent, route)
    keys = sets.where("vid = component").select("doc_id", "h")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    has_words = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    kept = rows.where(has_words).alias("r").join(keys.hint("merge").alias("k"), F.col("r.id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.h") == F.col("k.h")), "left_semi")
    kept = kept.dropDuplicates(["id", "h"])
    return kept.select("row.*").unionByName(rows.where(~has_words).select("row.*"))


def pairs(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(a, b: all links between different sets; vid, doc_id: which set a row has).

    Copies are not expanded: rows with one vid have equal sets. Empty sets are in neither. A dense group of n
    different sets has up to n * (n - 1) / 2 links; :func:`join` does not need them.
    """
    docs = with_hash(docs)
    sized, nodes = measured(docs, width)
    held = spread_join(sized.where("n_shingles > 0").select("doc_id", "hi", "lo"), nodes.select("hi", "lo", "vid"), ["hi", "lo"])
    links = found_links(docs, nodes, True, width, percent)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), held.select("vid", "doc_id")
