import hashlib
import math

import numpy as np
import pytest

from tilewright.llm import vector_codes as V


def plain(rows):
    """{id: (code, error, label error, digest)} of rows (id, vector, label) with vectors of one length, by comparing with all entries."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    nearest = lambda v, p: min((apart(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        new = []
        for p in range(8):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[nearest(v, p)[1]].append(part(v, p))
            new.append([[sum(x) // len(x) for x in zip(*own)] if own else c for own, c in zip(held, books[p])])
        books = new
    found = {i: ([nearest(v, p) for p in range(8)], label) for i, v, label in kept}
    errors = {}
    for near, label in found.values():
        errors[label] = errors.get(label, 0) + sum(d for d, _ in near)
    named = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), errors[label], named) for i, (near, label) in found.items()}


@pytest.mark.parametrize("seed, n, dims", [(1, 400, 64), (2, 200, 8), (3, 9, 32), (4, 120, 24)])
def test_codes_are_those_of_all_entries(spark, seed, n, dims):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)), 2 if seed == 2 else 6).astype(np.float32).astype(float).tolist()
    ids = rng.permutation(5 * n)[:n].tolist()
    rows = [(i, v, None if i % 7 == 0 else i % 3) for i, v in zip(ids, x)]
    rows += [(6 * n, None, 1), (6 * n + 1, [None] + [0.0] * (dims - 1), 1), (6 * n + 2, [float("nan")] * dims, None), (6 * n + 3, [float("-inf")] * dims, 2)]
    rows += [(6 * n + 4 + k, rows[0][1], 2) for k in range(30)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.report(df).collect()}
    assert got == plain(rows)


def test_refined_candidates_hold_the_nearest():
    rng = np.random.default_rng(5)
    for scale in (3, 1000, 10**7):
        entries, queries = rng.integers(-scale, scale, (16, 6)), rng.integers(-scale, scale, (500, 6))
        file = V.CellFile(entries)
        exact = ((queries[:, None] - entries) ** 2).sum(axis=2)
        lower, upper = file.bounds(queries)
        assert (lower <= exact).all() and (exact <= upper).all()
        best, apart = file.nearest(queries)
        assert (best == exact.argmin(axis=1)).all() and (apart == exact.min(axis=1)).all()
        assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.7  # the others need no distance


def test_lengths_labels_and_sizes_of_any_kind(spark):
    rows = [(1, [1.0] * 8, "a"), (2, [2.0] * 8, None), (3, [1.0] * 5, "a"), (4, [], "b"), (5, [1e300] * 8, "a"), (5, [-1e300] * 8, "a"), (None, [0.5] * 5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = V.report(df).collect()
    assert len(got) == 7 and all(r.error == 0 for r in got)
    assert {r.vec_id: r.code for r in got}[2] == "01" * 8 and {r.vec_id: r.code for r in got}[4] == "00" * 8
    assert V.report(df.limit(0)).collect() == []
    assert len(V.report(df.drop("label")).collect()) == 7


def test_codes_stand_for_vectors_nearby(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 32))
    x = centres[np.arange(300) % 16] + 0.01 * rng.normal(size=(300, 32))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    coded, books = V.encode(df)
    for r in V.decode(coded, books[32]).collect():
        assert np.abs(np.array(r.embedding) - x[r.vec_id]).max() < 0.1
