"""Repeats of ``LENGTH`` bytes by common-prefix intervals of a sparse enhanced suffix array.

1. Anchors: in every window of ``PASSAGE`` bytes the string of ``GRAM`` bytes with the smallest hash, and among
   these those of windows of ``LENGTH`` bytes. Equal windows have equal anchors at equal places, so it is enough to
   compare suffixes that begin at equal anchors. Anchors are counted, by occurrences and by texts that hold them;
   those that occur once are left out, the others are sorted arrays that tasks map into memory.
2. The surroundings of an anchor of long windows (as far as such a window with it can reach) are dealt by the
   anchor's hash. What a task sees twice, byte for byte, is repeated; it goes on once.
3. Per anchor the suffixes are sorted and a stack scan over the common prefixes of neighbours closes the
   intervals of the suffix array, longest common prefix R first. An interval keeps its members in order of their
   reversed left sides; a member that comes in is compared with its neighbours there, which have the longest
   common left extension L of all. Pairs with L + R >= ``LENGTH`` are repeats.
4. Anchors in more than ``HOT`` places are split by the bytes around them: the windows around an anchor fall into
   runs of ``STEPS`` starts, those of a run have all but so many bytes in common, and that core takes the anchor's
   place. Cores are counted as anchors are. What remains, windows that are equal but for a few bytes, goes through
   the same scan.

Windows that occur in one text several times take part with their first place. An anchor of ``PASSAGE`` bytes
that other texts hold too marks a passage that is shared, be it shorter than ``LENGTH`` bytes or not.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mapped
from .common import as_bytes, gather, mix, power_of_two, scatter, shared_dir, volume, written

LENGTH = 400
#: Passages of so many bytes that other texts hold are always seen, shorter ones than ``GRAM`` never.
PASSAGE = 200
GRAM = 128
REACH = LENGTH - GRAM  # of a window before its anchor
HOT = 20_000
#: Starts of windows in a run, first for hot anchors and then for cores that are hot themselves.
STEPS = (32, 1)
BUCKET_BYTES = 24 << 20
HELD_ANCHORS = 1_000_000


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h, width = join_hashes(h[:-width], h[width:]), 2 * width
    return h


def window_hashes(grams: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``LENGTH`` bytes, from those of their strings of ``GRAM`` bytes: of two halves that may overlap."""
    held, width, n = grams, GRAM, len(grams) - REACH
    while 2 * width <= LENGTH:
        held, width = join_hashes(held[:-width], held[width:]), 2 * width
    return mix(join_hashes(held[:n], held[LENGTH - width : LENGTH - width + n]))


def sliding(x: np.ndarray, width: int, best, worst) -> np.ndarray:
    """The ``best`` (a numpy ufunc) of all runs of ``width`` elements."""
    n = len(x)
    rows = np.append(x, np.full(-n % width, worst, dtype=x.dtype)).reshape(-1, width)
    before = best.accumulate(rows, axis=1).ravel()
    after = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def chosen(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the smallest of each ``width`` elements in a row, what is smallest for each such row)."""
    low = sliding(grams, width, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(width - 1, dtype=np.uint64)
    used = sliding(np.concatenate((edge, low, edge)), width, np.maximum, np.uint64(0))
    return np.flatnonzero(used == grams), low


NO_CODES, NO_PLACES = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)


def anchors(data: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places) of the anchors of a text's windows of ``PASSAGE`` bytes, the same of those of ``LENGTH`` bytes,
    and the starts of the latter that it has more than once.

    Of long windows that a text repeats only the first has its anchor here; with ``every`` all have.
    """
    if len(data) < PASSAGE:
        return NO_CODES, NO_PLACES, NO_CODES, NO_PLACES, NO_PLACES
    grams = gram_hashes(data)
    short, _ = chosen(grams, PASSAGE - GRAM + 1)
    if len(data) < LENGTH:
        return grams[short], short, NO_CODES, NO_PLACES, NO_PLACES
    places, low = chosen(grams, REACH + 1)
    hashes = grams[places]
    if every or len(np.unique(hashes)) == len(hashes):
        return grams[short], short, hashes, places, NO_PLACES
    # Only here can a window occur twice. The anchor is the first of equal ones.
    windows = window_hashes(grams)
    _, first, back, counts = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    first.sort()
    at = np.searchsorted(places, first)
    while len(wrong := np.flatnonzero(grams[places[at]] != low[first])):
        at[wrong] += 1
    at = np.unique(at)
    return grams[short], short, hashes[at], places[at], np.flatnonzero(counts[back] > 1)


def cores(data: np.ndarray, first: int, last: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(hash of the core, first and last start) of the runs of ``step`` windows that start from ``first`` to ``last``, where the text has any of a run.

    The core is what all windows of a run have in common. It begins at the last start.
    """
    for low in range(first, last + 1, step):
        high = min(low + step - 1, last)
        if max(low, 0) <= min(high, len(data) - LENGTH):
            yield xxhash.xxh3_64_intdigest(data[high : low + LENGTH].tobytes(), step), low, high


def own_anchor(text: np.ndarray, place: int) -> bool:
    """Whether the anchor at ``place`` is that of a window inside ``text``, so that it stands in all occurrences of ``text``."""
    grams = gram_hashes(text)
    low = sliding(grams, REACH + 1, np.minimum, np.uint64(2**64 - 1))
    return bool((low[max(0, place - REACH) : place + 1] == grams[place]).any()) if place < len(grams) else False


class Group:
    """The segments of one task, in the order of anchor and right side."""

    def __init__(self, code: np.ndarray, key: np.ndarray, place: np.ndarray, sides: np.ndarray, data: np.ndarray, grouped: bool = False):
        left, right, off = sides >> 10 & 1023, sides & 1023, sides >> 20
        sides = data.astype(np.uint16) + np.uint16(1)  # 0 stands for the end
        column = np.arange(REACH + LENGTH)
        sides[(column < REACH - left[:, None]) | (column >= REACH + right[:, None])] = 0
        after = np.ascontiguousarray(sides[:, REACH:].astype(">u2"))
        before = np.ascontiguousarray(sides[:, REACH - 1 :: -1].astype(">u2"))
        text = lambda x: x.view(f"S{2 * x.shape[1]}").ravel()
        order = np.lexsort((text(after), code))
        self.code, self.key, self.place, self.left, self.right, self.off = code[order], key[order], place[order], left[order], right[order], off[order]
        after, self.before = after[order], before[order]
        self.after = after
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[np.lexsort((text(self.before), self.code))] = np.arange(len(order))
        differs = after[1:] != after[:-1]
        self.prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH) if len(order) > 1 else np.empty(0, dtype=np.int64)
        self.member = np.argsort(self.rank)
        self.spans: list[tuple[int, int, int]] = []  # member, L, R
        self.groups: list[tuple[int, int, int, int]] | None = [] if grouped else None  # group, key, start, length
        self.widest = [-1] * len(order)

    def common_left(self, x: int, y: int) -> int:
        differs = self.before[x] != self.before[y]
        at = int(differs.argmax())
        return min(at if differs[at] else REACH, int(self.left[x]), int(self.left[y]))

    def meet(self, rank: int, other: int, depth: int) -> None:
        x, y = int(self.member[rank]), int(self.member[other])
        reach, depth = self.common_left(x, y), min(depth, int(self.right[x]), int(self.right[y]))
        if reach + depth >= LENGTH:
            for z in (x, y):
                if reach > self.widest[z]:  # depths only shrink
                    self.widest[z] = reach
                    self.spans.append((z, reach, depth))

    def merge(self, a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for rank in b:
            at = bisect_left(a, rank)
            if at:
                self.meet(rank, a[at - 1], depth)
            if at < len(a):
                self.meet(rank, a[at], depth)
            a.insert(at, rank)
        return a

    def scan(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, starts, ends) of what is repeated."""
        sets: list[list[int]] = []
        links: list[int] = []
        ranks, prefix = self.rank.tolist(), self.prefix.tolist()
        new = np.append(True, self.code[1:] != self.code[:-1]).tolist() if len(ranks) else []
        for i, rank in enumerate(ranks):
            if new[i]:
                self.close(sets, links, 0)
                sets, links = [[rank]], []
                continue
            self.close(sets, links, prefix[i - 1])
            links.append(prefix[i - 1])
            sets.append([rank])
        self.close(sets, links, 0)
        if not self.spans:
            return (np.empty(0, dtype=np.int64),) * 3
        x, reach, depth = np.array(self.spans, dtype=np.int64).T
        return self.key[x], self.place[x] - reach, self.place[x] + depth

    def close(self, sets: list[list[int]], links: list[int], depth: int) -> None:
        """Closes the intervals whose common prefix is at least ``depth``."""
        while links and links[-1] >= depth:
            b, a = sets.pop(), sets.pop()
            deep = links.pop()
            sets.append(self.merge(a, b, deep))
            if self.groups is not None and deep > depth and (not links or links[-1] < deep):
                self.report(sets[-1], deep)

    def report(self, ranks: list[int], depth: int) -> None:
        """The maximal repeats of a whole interval: its parts by common left sides that differ after ``depth`` too."""
        members = [int(self.member[r]) for r in ranks]
        shared = [self.common_left(x, y) for x, y in zip(members, members[1:])]
        stack: list[tuple[int, int]] = []  # (common left side, first member) of the open parts
        for i in range(1, len(members) + 1):
            now, first = (shared[i - 1] if i < len(members) else -1), i - 1
            while stack and stack[-1][0] > now:
                left, first = stack.pop()
                part = members[first:i]
                right = min(depth, *(int(self.right[x]) for x in part))
                if left + right >= LENGTH and int(self.prefix[min(part) : max(part)].min()) == depth:
                    text = (np.concatenate((self.before[part[0], :left][::-1], self.after[part[0], :right])) - np.uint16(1)).astype(np.uint8)
                    places = {(int(self.key[x]), int(self.place[x]) - left) for x in part}
                    if len(places) > 1 and any(own_anchor(text, left + off) for off in set(self.off[part].tolist())):
                        group = np.uint64(xxhash.xxh3_64_intdigest(text.tobytes())).view(np.int64)
                        self.groups += [(int(group), key, start, left + right) for key, start in places]
            if not stack or stack[-1][0] < now:
                stack.append((now, first))


def united(key: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a key as one that overlap, touch or have at most ``gap`` bytes between them."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    new_key = np.append(True, key[1:] != key[:-1])
    # Ends of one key shifted beyond those of the keys before it, so that one running maximum serves all.
    base = np.cumsum(new_key) * (int(end.max()) + gap + 1)
    furthest = np.maximum.accumulate(end + base)
    first = new_key.copy()
    first[1:] |= start[1:] + base[1:] > furthest[:-1] + gap
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(key)) - 1
    return key[at], start[at], furthest[last] - base[last]


SEGMENTS = "bucket int, code binary, key binary, place binary, sides binary, data binary"
NAMES = ["bucket", "code", "key", "place", "sides", "data"]
GROUPS = "group long, key long, start long, length long"
SPANS = "bucket int, shared boolean, key binary, start binary, end binary"


def found_repeats(docs: DataFrame, hot_places: int, grouped: bool) -> DataFrame:
    """Of ``docs`` (key, text): spans dealt by key (``SPANS``), or with ``grouped`` the rows of :func:`repeat_groups`."""
    buckets = power_of_two(volume(docs)[1] / BUCKET_BYTES)
    folder = f"{shared_dir(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    mask = np.uint64(buckets - 1)
    held: list[set[int]] = []  # per level the buckets that have codes

    def spread(codes: np.ndarray) -> np.ndarray:
        return (mix(codes) & mask).astype(np.int64)

    def among(codes: np.ndarray, kind: str, level: int) -> np.ndarray:
        found, bucket = np.zeros(len(codes), dtype=bool), spread(codes)
        for b in np.unique(bucket):
            if b in held[level] and len(known := mapped.load(f"{folder}/{kind}{level}-{b}.npy")):
                mine = np.flatnonzero(bucket == b)
                at = np.searchsorted(known, codes[mine])
                at[at == len(known)] = 0
                found[mine] = known[at] == codes[mine]
        return found

    def opened(texts: list[np.ndarray], which: np.ndarray, codes: np.ndarray, places: np.ndarray, upto: int) -> list[tuple]:
        """Per level (which text, code, place, anchor, first and last start) of what stands for the anchors of texts: themselves, or the cores of those that are hot."""
        first, last, own, out = places - REACH, places, places, []
        for level in range(upto + 1):
            if level == upto and level == len(held):  # not counted yet
                return [*out, (which, codes, places, own, first, last)]
            hit = among(codes, "codes", level)
            hot = among(codes, "hot", level) if level + 1 < len(held) or upto == len(held) else np.zeros(len(codes), dtype=bool)
            out.append(tuple(x[hit & ~hot] for x in (which, codes, places, own, first, last)))
            # Two anchors of a text may have a run in common.
            runs = [(k, *run, p) for k, p, f, l in zip(*(x[hot].tolist() for x in (which, own, first, last))) for run in cores(texts[k], f, l, STEPS[level])]
            if not grouped:
                runs = list({run[:4]: run for run in runs}.values())
            if not runs:
                break
            codes = np.array([r[1] for r in runs], dtype=np.uint64)
            which, first, last, own = (np.array([r[c] for r in runs], dtype=np.int64) for c in (0, 2, 3, 4))
            places = last
        return out

    def counter(level: int):
        """Codes of a level with the numbers of texts that have them, or with ``grouped`` of their occurrences."""

        def of(batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            found = [anchors(data, grouped) for data in batch]
            if level == 0 and not grouped:
                return np.concatenate([np.full(len(f[0]), k) for k, f in enumerate(found)]), np.concatenate([f[0] for f in found])
            which, codes, places = (np.concatenate(x) for x in zip(*((np.full(len(f[2]), k), f[2], f[3]) for k, f in enumerate(found))))
            if level == 0:
                return which, codes
            levels = opened(batch, which, codes, places, level)
            return levels[level][:2] if len(levels) > level else (NO_PLACES, NO_CODES)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0

            def flush() -> pa.RecordBatch:
                codes, counts = np.unique(np.concatenate([NO_CODES, *parts]), return_counts=True)
                return scatter(spread(codes), [codes, counts.astype(np.uint32)], ["code", "count"])

            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    which, codes = of([np.frombuffer(as_bytes(text.as_py()), dtype=np.uint8) for text in batch.column(0).slice(i, 500)])
                    if not grouped:  # once for each text
                        order = np.lexsort((codes, which))
                        which, codes = which[order], codes[order]
                        codes = codes[np.append(True, (codes[1:] != codes[:-1]) | (which[1:] != which[:-1]))[: len(codes)]]
                    parts.append(codes)
                    size += len(codes)
                    if size >= HELD_ANCHORS:
                        yield flush()
                        parts, size = [], 0
            yield flush()

        return count

    def keep(level: int):
        def save(key: tuple, part: pa.Table) -> pa.Table:
            codes, counts = gather(part, "code", np.uint64), gather(part, "count", np.uint32).astype(np.int64)
            codes, back = np.unique(codes, return_inverse=True)
            counts = np.bincount(back, weights=counts, minlength=len(codes))
            bucket, hot = key[0].as_py(), counts > hot_places
            mapped.save(f"{folder}/codes{level}-{bucket}.npy", codes[counts > 1])
            mapped.save(f"{folder}/hot{level}-{bucket}.npy", codes[hot])
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "hot": pa.array([int(hot.sum())], pa.int64())})

        return save

    for level in range(len(STEPS) + 1):
        counted = docs.select("text").mapInArrow(counter(level), "bucket int, code binary, count binary")
        rows = counted.groupBy("bucket").applyInArrow(keep(level), "bucket int, hot long").collect()  # a row per bucket
        held.append({r["bucket"] for r in rows})
        if not any(r["hot"] for r in rows):
            break

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield from cut_some(batch.slice(i, 1000))

    def cut_some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, texts, found, spans = batch.column(0).to_pylist(), [], [], []
        for key, text in zip(keys, batch.column(1)):
            texts.append(np.frombuffer(as_bytes(text.as_py()), dtype=np.uint8))
            found.append(anchors(texts[-1], grouped))
            if len(twice := found[-1][4]):
                spans.append(np.stack((np.full(len(twice), key), twice, twice + LENGTH)))
        if not grouped:
            which, codes, places = (np.concatenate(x) for x in zip(*((np.full(len(f[0]), k), f[0], f[1]) for k, f in enumerate(found))))
            other = among(codes, "codes", 0)
            key, start, end = united(np.array(keys, dtype=np.int64)[which[other]], places[other], places[other] + GRAM, PASSAGE)
            empty = np.empty((len(key), 0), dtype=np.uint8)
            yield scatter(spread(key.view(np.uint64)) + 2 * buckets, [end, key, start, empty, empty], NAMES[1:])
        which, codes, places = (np.concatenate(x) for x in zip(*((np.full(len(f[2]), k), f[2], f[3]) for k, f in enumerate(found))))
        seen: dict[bytes, list[tuple]] = {}
        kept, rows = [], []
        for k, code, place, anchor, first, last in (x for level in opened(texts, which, codes, places, len(held) - 1) for x in zip(level[0].tolist(), level[1].tolist(), *(c.tolist() for c in level[2:]))):
            key, data = keys[k], texts[k]
            begin, stop = max(first, 0), min(last, len(data) - LENGTH) + LENGTH
            if stop - begin < LENGTH:
                continue
            row = np.zeros(REACH + LENGTH, dtype=np.uint8)
            row[REACH - (place - begin) : REACH + (stop - place)] = data[begin:stop]
            same = seen.setdefault(xxhash.xxh3_128_digest(row.tobytes() + struct.pack("<QHH", code, place - begin, stop - place)), [])
            if same and not grouped:
                spans += [np.array([[x[0]], [x[1]], [x[2]]]) for x in (same + [(key, begin, stop)] if len(same) == 1 else [(key, begin, stop)])]
            else:
                kept.append((code, key, place, (anchor - place) << 20 | (place - begin) << 10 | (stop - place)))
                rows.append(row)
            same.append((key, begin, stop))
        if kept:
            code, key, place, sides = zip(*kept)
            code, data = np.array(code, dtype=np.uint64), np.stack(rows)
            bucket = spread(code)
            order = np.argsort(bucket, kind="stable")
            yield scatter(bucket[order], [code[order], np.array(key, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order], np.array(sides, dtype=np.uint32)[order], data[order]], NAMES[1:])
        if spans and not grouped:
            key, start, end = united(*np.concatenate(spans, axis=1))
            empty = np.empty((len(key), 0), dtype=np.uint8)
            yield scatter(spread(key.view(np.uint64)) + buckets, [end, key, start, empty, empty], NAMES[1:])

    def find(key: tuple, part: pa.Table) -> pa.Table:
        kind = key[0].as_py() // buckets
        code, keys, place = gather(part, "code", np.int64), gather(part, "key", np.int64), gather(part, "place", np.int64)
        if kind == 0:
            sides = gather(part, "sides", np.uint32).astype(np.int64)
            data = gather(part, "data", np.uint8).reshape(-1, REACH + LENGTH)
            group = Group(code, keys, place, sides, data, grouped)
            spans = group.scan()
            if grouped:
                return group_rows(*(np.array(c, dtype=np.int64) for c in zip(*group.groups))) if group.groups else group_rows(*[NO_PLACES] * 4)
        else:
            spans = keys, place, code
        keys, start, end = united(*spans) if kind < 2 else spans
        out = scatter(spread(keys.view(np.uint64)), [keys, start, end], ["key", "start", "end"])
        return pa.Table.from_batches([out]).add_column(1, "shared", pa.array([kind == 2] * out.num_rows, pa.bool_()))

    segments = docs.select("key", "text").mapInArrow(cut, SEGMENTS).groupBy("bucket")
    return segments.applyInArrow(find, GROUPS if grouped else SPANS)


def group_rows(group: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Table:
    return pa.table({"group": group, "key": key, "start": start, "length": length})


def listed(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(keys, starts and ends of each as lists) of spans in the order of their keys."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else NO_PLACES
    offsets = pa.array(np.append(at, len(key)).astype(np.int32))
    return key[at], pa.ListArray.from_arrays(offsets, pa.array(start)), pa.ListArray.from_arrays(offsets, pa.array(end))


def repeated_spans(docs: DataFrame, hot_places: int = HOT) -> DataFrame:
    """key, starts, ends, shared_starts, shared_ends (arrays) of ``docs`` (key, text), for texts that have any: the
    repeated bytes, and the passages that other texts hold too."""

    def collect(part: pa.Table) -> pa.Table:
        sides = []
        for shared, gap in ((False, 0), (True, PASSAGE)):
            own = part.filter(pc.equal(part.column("shared"), shared))
            sides.append(listed(*united(*(gather(own, x, np.int64) for x in ("key", "start", "end")), gap)))
        keys = np.union1d(sides[0][0], sides[1][0])
        columns = {"key": pa.array(keys, pa.int64())}
        for name, (own, starts, ends) in zip(("", "shared_"), sides):
            at = np.searchsorted(own, keys)
            there = np.isin(keys, own)
            take = pa.array([int(x) if y else None for x, y in zip(at, there)], pa.int64())
            columns |= {f"{name}starts": starts.take(take), f"{name}ends": ends.take(take)}
        return pa.table(columns)

    schema = "key long, starts array<long>, ends array<long>, shared_starts array<long>, shared_ends array<long>"
    return found_repeats(docs, hot_places, False).groupBy("bucket").applyInArrow(collect, schema)


def repeat_groups(docs: DataFrame, hot_places: int = HOT) -> DataFrame:
    """group, key, start, length: the maximal repeats of ``docs`` (key, text) with all their occurrences.

    A group is one string of ``LENGTH`` bytes or more: its occurrences differ before and after it, or end there.
    Keys are those of rows. A null or shorter text is in no group, no rows give none; other columns are ignored.

    What the scan finds around an anchor ends where its surroundings do. Pieces that stand at the same distance
    from each other in all of their occurrences, and overlap or touch, are joined to one repeat. Where a repeat of a
    few documents runs through a part that more of them have, and that is longer than the surroundings of an anchor
    (of a hot one: than a window), it comes as one group on either side of that part, which is a group itself.
    """
    pieces = written(found_repeats(docs, hot_places, True).distinct(), "repeats-pieces")
    first = F.min(F.struct("key", "start")).alias("first")
    heads = pieces.groupBy("group", "length").agg(first, F.count("*").alias("n"))
    apart = F.sum(F.xxhash64("key", F.col("start") - F.col("first.start")).cast("decimal(38,0)")).alias("shape")
    shapes = pieces.join(heads, ["group", "length"]).groupBy("group", "length", "n", "first").agg(apart)
    shapes = shapes.select("group", "length", "n", "shape", F.col("first.key").alias("at"), F.col("first.start").alias("begin"))
    # One document's pieces of one shape, in the order of their starts.
    order = Window.partitionBy("n", "shape", "at").orderBy("begin", "length", "group")
    furthest = F.max(F.col("begin") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    shapes = shapes.withColumn("part", F.sum(F.when(F.col("begin") <= furthest, 0).otherwise(1)).over(order))
    head = F.min(F.struct("begin", "length", "group")).alias("head")
    whole = shapes.groupBy("n", "shape", "at", "part").agg(head, (F.max(F.col("begin") + F.col("length")) - F.min("begin")).alias("whole"))
    whole = whole.select("head.group", "head.length", "whole")
    return pieces.join(whole, ["group", "length"]).select("group", "key", "start", F.col("whole").alias("length"))


def remove_repeats(docs: DataFrame, hot_places: int = HOT) -> DataFrame:
    """doc_id, text, starts, ends, shared_starts, shared_ends for every row, as spans of its UTF-8 bytes.

    The first are what is repeated of its text. The others are passages that another row holds too, from the first
    to the last anchor of each: none is missed that has ``PASSAGE`` bytes, be it too short to be removed.

    Null and empty texts and those shorter than ``LENGTH`` have no spans. Repeated rows are repeats of each
    other. Rows with one id and different texts are different texts.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed, hot_places)
    return keyed.join(spans.hint("merge"), "key", "left").select("doc_id", "text", "starts", "ends", "shared_starts", "shared_ends")
