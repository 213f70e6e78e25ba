import hashlib
import random
import zlib

import pytest

from tilewright.llm import merkle as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1]))


def tree(leaves):
    """(the last node, for each leaf its steps upward)."""
    steps, level, over = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        up, above = [], []
        for i in range(0, len(level), 16):
            run = level[i : i + 16]
            for slot in range(len(run)):
                for k in over[i + slot]:
                    steps[k].append((slot, run[:slot] + run[slot + 1 :]))
            up.append(digest(run))
            above.append([k for slot in range(len(run)) for k in over[i + slot]])
        level, over = up, above
    return level[0], steps


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = (own, *tree([leaf(r) for r in own]))
    root, upper = tree([built[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        own, subroot, steps = built[s]
        for row, path in zip(own, steps):
            path = path + above
            bent = row
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                bent = (row[0], row[1].translate({c: c + 32 for c in range(65, 91)}), *row[2:])
            found = leaf(bent)
            for slot, siblings in path:
                found = digest([*siblings[:slot], found, *siblings[slot:]])
            out.append((row[0], leaf(row), subroot, root, digest(x for _, siblings in path for x in siblings), found, found == root))
    return out


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    texts = ["", None, "lower only", "Ünïcode ÀÉ Mixed", "ABC" * 50, "x\ty\n"]
    return [(i, rng.choice(texts), rng.choice(["de", None]), rng.choice(sources), rng.choice([None, -3, 12]), "extra") for i in rng.sample(range(10 * n), n)]


def key(row):
    return [(x is not None, x if x is not None else 0) for x in row]


@pytest.mark.parametrize("seed, n, sources", [(1, 700, ["a", "b", None, "é", "B"]), (2, 300, ["only"]), (3, 40, [f"s{k}" for k in range(300)]), (4, 1, ["x"]), (5, 17, ["x"])])
def test_manifest_is_the_plain_one(spark, seed, n, sources):
    rows = rows_of(seed, n, sources)
    if n > 10:
        rows += [rows[0], rows[0], (rows[1][0], "other", *rows[1][2:]), (None, "no Id", "de", rows[2][3], 1, None), (None, "no Id", "de", rows[2][3], 1, None)]
    got = M.manifest(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_tampering_shows(spark):
    rows = rows_of(6, 200, ["a", "b"])
    for r in M.manifest(spark.createDataFrame(rows, COLUMNS)).collect():
        row = next(x for x in rows if x[0] == r.doc_id)
        bent = zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None and any("A" <= c <= "Z" for c in row[1])
        assert r.verified == (not bent)


def test_no_rows(spark):
    assert M.manifest(spark.createDataFrame([], COLUMNS)).collect() == []
